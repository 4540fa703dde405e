"""Leading eigenvectors of X X' for any number of takers, X being right answers.

Block Lanczos iteration with full orthogonalisation and thick restarts.  Right answers
are packed once by stripes of items and stay where they are; only numbers per taker and
column are sent and added up: a step is one job in which a stripe gets the newest vectors
and gives X (X' z) of its items.  The basis stays in taker blocks; inner products, a few
columns wide, are all that reaches the driver.  Steps run on RDDs that share their
partitioning, so neither answers nor basis are shuffled again, and wide blocks of vectors
keep the steps few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.operators.parts import STORED, dealt, own_part, stored, without_shuffles
from itemspark.operators.tiles import blocks_of
from itemspark.session import cut_lineage, drop_staged

BLOCK = 2048                # takers of a block, about
STRIPE = 4_000_000          # right answers of a stripe of items, about
SENT = 1 << 25              # bytes of vectors that a stripe gets at once, at least a column
WIDE = 64                   # columns that a step adds, if takers and the bytes sent at once allow
CHUNK = 1 << 15             # numbers that are added up at once, so that they stay in a core's cache


def placed_takers(takers: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """taker, block and at (from 0, ascending with the block), and where blocks begin; the
    last entry is the number of takers."""
    keys = takers.select("taker").where("taker IS NOT NULL").distinct()
    places = blocks_of(keys, "taker", BLOCK)
    sizes = {r["block"]: r["count"] for r in places.groupBy("block").count().collect()}     # numbers per block
    begins = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(max(sizes, default=-1) + 1)])]).astype("i8")
    begin = F.element_at(F.array(*[F.lit(int(b)) for b in begins]), F.col("block") + 1)
    return places.select("taker", "block", (begin + F.col("place")).cast("int").alias("at")), begins


def stored_stripes(right: DataFrame, places: DataFrame) -> tuple[RDD, int]:
    """Per stripe the taker places by item and the item numbers by taker, where each begins
    and a place of each such taker, and the number of stripes."""
    stripes = max(right.sparkSession.sparkContext.defaultParallelism, right.count() // STRIPE + 1)

    def pack(group: pa.Table) -> pa.Table:
        item = group.column("item").combine_chunks().dictionary_encode("encode").indices.to_numpy()
        at = group.column("at").to_numpy()
        order = np.argsort(item, kind="stable")
        item, at = item[order], at[order]
        back = np.argsort(at, kind="stable")
        begin = [np.flatnonzero(np.r_[True, np.diff(x) > 0]) for x in (item, at[back])]
        fields = {"at": at, "first": begin[0], "back": item[back], "begin": begin[1], "whose": back[begin[1]]}
        return pa.table({"stripe": group.column("stripe")[:1], **{
            c: pa.array([x.astype("<i4").tobytes()], pa.binary()) for c, x in fields.items()}})

    cells = right.join(places.select("taker", "at"), "taker").select(
        F.pmod(F.xxhash64("item"), F.lit(stripes)).cast("int").alias("stripe"), "item", "at")
    packed = cut_lineage(cells.groupBy("stripe").applyInArrow(
        pack, "stripe int, at binary, first binary, back binary, begin binary, whose binary"), "stripes")
    return dealt(packed.rdd.map(lambda r: ((r[0], -1, -1), tuple(np.frombuffer(x, "<i4") for x in r[1:]))), stripes), stripes


def first_state(context: SparkContext, begins: np.ndarray, width: int, centred: bool) -> RDD:
    """A random start, by block; for the centred problem the basis begins with the constant
    vector, to which all others are made orthogonal."""
    filled = np.flatnonzero(np.diff(begins)).tolist()

    def begun(block: int) -> tuple:
        n = int(begins[block + 1] - begins[block])
        return state_row(block, np.ones((int(centred), n)) / np.sqrt(begins[-1]),
                         np.random.default_rng([42, block]).normal(size=(width, n)))
    blocks = max(1, len(begins) - 1)
    return dealt(context.parallelize(filled, max(1, min(len(filled), context.defaultParallelism))).map(begun), blocks)


def state_row(block: int, basis: np.ndarray, image: np.ndarray) -> tuple:
    """A block's basis and new vectors, with their inner products in this block."""
    return (block,), (basis, image, np.vstack([basis, image]) @ image.T)


def inner_products(state: RDD, width: int) -> np.ndarray:
    """The sums over all blocks, added up by groups of blocks first; (basis + new) x new numbers."""
    groups = int(np.ceil(np.sqrt(state.getNumPartitions())))
    added = state.map(lambda row: (row[0][0] % groups, row[1][2])).reduceByKey(lambda x, y: x + y, groups)
    total = sum(x for _, x in added.collect())
    without_shuffles(added)
    return np.reshape(total, (-1, width))


def whitening(g: np.ndarray, scale: float) -> np.ndarray:
    """Turns vectors of Gram matrix ``g`` into orthonormal ones; 0 for directions that are
    rounding errors of vectors of squared length ``scale``."""
    values, basis = np.linalg.eigh(g)
    kept = values > max(scale * 1e-20, values.max() * 1e-10)
    return basis * np.where(kept, 1.0 / np.sqrt(np.where(kept, values, 1.0)), 0.0)


def _orthonormal(basis: np.ndarray, image: np.ndarray, turns: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for overlap, white in turns:
        image = white.T @ (image - overlap.T @ basis)
    return image


def orthonormal_turns(state: RDD, width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """What makes the new vectors orthonormal to the basis and to each other, their inner
    products with the basis, and the Gram matrix of what the basis leaves of them.  A
    second pass always follows the first: errors would grow from step to step otherwise."""
    inner = inner_products(state, width)
    raw = inner[:-width]
    left = inner[-width:] - raw.T @ raw
    scale = max(np.diag(inner[-width:]).max(), 1e-300)
    turns, overlap, rest, known = [], raw, left, scale
    for _ in range(5):
        white = whitening((rest + rest.T) / 2, known)
        turns.append((overlap, white))
        alive = white.any(axis=0)
        if not alive.any() or (len(turns) > 1 and gap < 1e-7):
            break
        now = list(turns)

        def again(row, now=now):
            basis, image, _ = row[1]
            return state_row(row[0][0], basis, _orthonormal(basis, image, now))
        inner = inner_products(state.map(again), width)
        overlap, rest, known = inner[:-width], inner[-width:] - inner[:-width].T @ inner[:-width], 1.0
        gap = max(np.abs(overlap).max(initial=0.0), np.abs(inner[-width:] - np.diag(alive)).max())
    return turns, raw, left


def sums(x: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of the rows ``at`` of ``x`` from each of ``first`` to the next."""
    out = np.empty((len(first), x.shape[1]))
    ends = np.append(first, len(at))
    most, i = max(1, CHUNK // x.shape[1]), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        out[i:j] = np.add.reduceat(x[at[ends[i]:ends[j]]], first[i:j] - ends[i], axis=0)
        i = j
    return out


def products(rows, begins: np.ndarray):
    """X (X' z) of a stripe's answers, which come first, and vectors, sorted by part: key
    (block, part) and numbers by column and taker."""
    answers, part, z = None, None, None
    filled = np.flatnonzero(np.diff(begins))

    def told():
        at, first, back, begin, whose = answers
        total = np.zeros_like(z)
        total[at[whose]] = sums(sums(z, at, first), back, begin)
        for b in filled:
            yield (int(b), part), np.ascontiguousarray(total[begins[b]:begins[b + 1]].T)

    for key, value in rows:
        if key[1] < 0:
            answers = value
            continue
        if answers is None:             # a stripe without right answers
            return
        if key[1] != part:
            if part is not None:
                yield from told()
            part, z = key[1], np.empty((int(begins[-1]), len(value)))
        z[begins[key[2]]:begins[key[2] + 1]] = value.T
    if part is not None:
        yield from told()


def next_state(state: RDD, stripes: RDD, n_stripes: int, begins: np.ndarray, width: int,
               turns: list[tuple[np.ndarray, np.ndarray]], kept: np.ndarray | None) -> RDD:
    """The basis (turned by ``kept`` at a restart) with the new vectors made orthonormal,
    and their images X (X' z)."""
    step = max(1, SENT // (8 * max(1, int(begins[-1]))))        # columns that are sent at once

    def new(row):
        basis, image, _ = row[1]
        z = _orthonormal(basis, image, turns)
        for part, c in enumerate(range(0, width, step)):
            for stripe in range(n_stripes):
                yield (stripe, part, row[0][0]), z[c:c + step]

    def grown(row):
        basis, image, _ = row[1]
        z = _orthonormal(basis, image, turns)
        return row[0], np.vstack([basis if kept is None else kept.T @ basis, z])

    def added(rows):
        block, basis, image = None, None, None
        for key, x in rows:             # the basis comes first
            if len(key) == 1:
                block, basis, image = key[0], x, np.zeros((width, x.shape[1]))
            else:
                image[key[1] * step:key[1] * step + len(x)] += x
        if block is not None:
            yield state_row(block, basis, image)

    sent = state.flatMap(new).repartitionAndSortWithinPartitions(n_stripes, own_part)
    images = stripes.union(sent).mapPartitions(lambda rows: products(rows, begins))
    blocks = state.getNumPartitions()
    basis = state.map(grown, preservesPartitioning=True)
    partial = images.partitionBy(blocks, own_part).map(lambda row: row, preservesPartitioning=True)
    return basis.union(partial).mapPartitions(added, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)


def leading(right: DataFrame, takers: DataFrame, k: int, centred: bool = False, extra: int = 4, most_columns: int = 240,
            tolerance: float = 1e-6, most: int = 400) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` largest eigenvalues of X X' and taker, u1..uk; ``centred`` takes the mean
    of the takers off every item.

    ``right``: taker, item of right answers.  A basis of more than ``most_columns`` vectors
    (eight blocks at least) is cut to its best ones, from which the iteration goes on.  It ends when |X X' u - s u|
    is at most ``tolerance`` times the largest eigenvalue for every vector, and raises if
    it doesn't within ``most`` steps.  Beyond the rank of X, values and vectors are 0.
    """
    places, begins = placed_takers(takers)
    places = cut_lineage(places, "places")
    n = max(1, int(begins[-1]))
    width, first = max(k + extra, min(WIDE, n // 50, SENT // (8 * n))), int(centred)
    stripes, n_stripes = stored_stripes(right, places)
    state = first_state(places.sparkSession.sparkContext, begins, width, centred)
    try:
        return _iterated(state, stripes, n_stripes, places, begins, k, width, first, most_columns, tolerance, most)
    finally:
        stripes.unpersist()


def _iterated(state: RDD, stripes: RDD, n_stripes: int, places: DataFrame, begins: np.ndarray, k: int, width: int,
              first: int, most_columns: int, tolerance: float, most: int) -> tuple[np.ndarray, DataFrame]:
    h = np.zeros((first, first))        # the problem in the basis
    before, path = None, None
    for done in range(most):
        if done and done % STORED == 0:
            last = path
            state, path = stored(state, places.sparkSession, "basis")
            if last is not None:
                drop_staged(places.sparkSession, last)
        turns, overlap, left = orthonormal_turns(state, width)
        if before is not None:          # the state is kept now; files of past steps would pile up
            if done == 1:
                without_shuffles(stripes)
            without_shuffles(state)
            before.unpersist()
        if len(h) > first:              # the first state holds no images yet
            h[:, -width:] = overlap
            h[-width:] = overlap.T
            values, vectors = np.linalg.eigh((h + h.T)[first:, first:] / 2)
            order = np.argsort(values)[::-1]
            values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
            tail = vectors[-width:, :k]
            rest = np.sqrt(np.maximum((tail * (left @ tail)).sum(axis=0), 0.0))
            if len(values) >= k and (rest <= tolerance * values[0]).all():
                found = _vectors(state, places, begins, vectors[:, :k], values[:k], first)
                if path is not None:
                    drop_staged(places.sparkSession, path)
                return values[:k], found
        kept = None
        if len(h) >= first + max(most_columns // width, 8) * width:
            m = 3 * width
            kept = np.zeros((len(h), first + m))
            kept[:first, :first] = np.eye(first)
            kept[first:, first:] = vectors[:, :m]
            h = np.zeros((first + m, first + m))
            h[first:, first:] = np.diag(values[:m])
        before, state = state, next_state(state, stripes, n_stripes, begins, width, turns, kept)
        h = np.pad(h, ((0, width), (0, width)))
    raise ValueError(f"{k} singular values did not settle in {most} steps")


def _vectors(state: RDD, places: DataFrame, begins: np.ndarray, turn: np.ndarray, values: np.ndarray,
             first: int) -> DataFrame:
    names = [f"u{d + 1}" for d in range(len(values))]
    turn = turn * (values > values[0] * 1e-14)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u = np.frombuffer(row["u"]).reshape(len(names), -1)
                at = np.arange(u.shape[1], dtype="i4") + np.int32(begins[row["block"]])
                yield pa.record_batch([pa.array(at), *map(pa.array, u)], names=["at", *names])
    packed = state.map(lambda row: (row[0][0], (turn.T @ row[1][0][first:]).tobytes()))
    rows = places.sparkSession.createDataFrame(packed, "block int, u binary").mapInArrow(
        run, "at int, " + ", ".join(f"{c} double" for c in names))
    found = cut_lineage(places.join(rows, "at").select("taker", *names), "vectors")
    state.unpersist()
    return found

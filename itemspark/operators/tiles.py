"""Bounded Newton fits of response models over cells that stay where they are.

Items and takers are dealt into blocks.  The cells of one item block and one taker
block are a tile: one row of packed arrays in a table that is stored once, bucketed by
tile, and dealt once to parts that keep it.  A step sends the parameters of a part's blocks
to it (some numbers per item and taker, whatever the number of cells), adds up gradients
and k x k curvatures inside, and sends these sums to the block that moves; the cells are
never shuffled again.  A hot item or taker is spread over the tiles of its block.  Steps run
on RDDs that share their partitioning, so a round is one job.

All models of a sweep sit in the same arrays, so tiles are read once for all of them;
models that have settled are left out of later rounds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.operators.parts import dealt, own_part
from itemspark.session import cut_lineage, remember_table, staging_path

BLOCK = 1024                # items or takers of a block, about, where most cells are asked
LARGEST = 32                # times that where few are,
TILE_CELLS = 100_000        # so that a tile has about so many cells: fewer tiles, fewer copies of parameters;
TILES = 100                 # more where the cells would give more tiles than these, but
MOST_CELLS = 1_000_000      # no more than so many
SUM_BYTES = 1 << 24         # of one block's sums in a tile, at most
HELD_BYTES = 1 << 26        # of sums that a task adds up before it passes them on, about
CHUNK = 1 << 17             # numbers that are added up at once, so that they stay in a core's cache
NARROW = 3                  # dimensions of an item up to which cells needn't lie in the order of their places
PART_TILES = 100            # tiles of a part, about, where there are more than one a core
MOST_STEP = 2.0             # of a parameter in one round: a quadratic model holds near by only


def block_size(n_cells: int, n_items: int, n_takers: int, sums: int) -> int:
    """Items or takers of a block when a place has ``sums`` numbers: at least BLOCK, and so
    many that the number of tiles follows the cells, not items times takers."""
    wanted = min(max(TILE_CELLS, n_cells // TILES), MOST_CELLS)
    side = (wanted * n_items * n_takers / max(n_cells, 1)) ** 0.5
    return int(max(BLOCK, min(side, LARGEST * BLOCK, SUM_BYTES // (8 * sums))))


def blocks_of(keys: DataFrame, key: str, size: int) -> DataFrame:
    """key, block and place (from 0) of every distinct key; blocks hold about ``size``."""
    n = keys.count() // size + 1
    dealt = keys.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    return cut_lineage(dealt.withColumn("place", F.row_number().over(
        Window.partitionBy("block").orderBy(key)) - 1), "blocks")


def stored_tiles(cells: DataFrame, items: DataFrame, takers: DataFrame) -> DataFrame:
    """tile, ib, tb and cells (places and answers, packed), bucketed by tile."""
    spark = cells.sparkSession

    def pack(batches):
        for batch in batches:
            packed = []
            for row in batch.column("cells"):
                own = row.values.take(pc.sort_indices(row.values.field("i")))      # items of a tile one by one
                packed.append(b"".join(own.field(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()
                                       for c, kind in (("y", "<f8"), ("i", "<i4"), ("t", "<i4"))))
            yield pa.record_batch([batch.column("ib"), batch.column("tb"), pa.array(packed, pa.binary()), batch.column("tile")],
                                  names=["ib", "tb", "cells", "tile"])

    own = (cells.where("y IS NOT NULL")
           .join(items.toDF("item", "ib", "i"), "item").join(takers.toDF("taker", "tb", "t"), "taker"))
    packed = (own.groupBy("ib", "tb").agg(F.collect_list(F.struct("i", "t", F.col("y").cast("double").alias("y"))).alias("cells"))
              .withColumn("tile", F.shiftleft(F.col("ib").cast("long"), 32) + F.col("tb"))
              .mapInArrow(pack, "ib int, tb int, cells binary, tile long"))
    name = f"itemspark_tiles_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (packed.repartition(buckets, "tile").write.bucketBy(buckets, "tile").sortBy("tile")
     .option("path", staging_path(spark, "tiles")).saveAsTable(name))
    remember_table(spark, name)
    return spark.table(name)


# --- one block's arrays ----------------------------------------------------

def newton(x: np.ndarray, least: np.ndarray, gradient: np.ndarray, curvature: np.ndarray,
           free: np.ndarray, bend: np.ndarray, relaxation: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """One step up for many small problems (rows), and their projected gradients.

    A parameter at its bound whose gradient points below stays there; the others move
    by Newton's step for them and are then put back above their bounds.  ``bend`` is the
    sum of p (1 - p) over a problem's cells.  A step that would move the cells' logits by
    r on average is damped by log(1 + 2r) / 2r, as the curvature changes with them; a
    small one is taken ``relaxation`` times.
    """
    still = ~free | ((x <= least) & (gradient <= 0))
    gradient = np.where(still, 0.0, gradient)
    step = np.zeros_like(gradient)
    bits = ~still @ (1 << np.arange(x.shape[1]))
    for code in np.unique(bits[bits > 0]):          # problems with the same free parameters together
        rows, own = np.flatnonzero(bits == code), np.flatnonzero(code >> np.arange(x.shape[1]) & 1)
        step[np.ix_(rows, own)] = np.linalg.solve(curvature[np.ix_(rows, own, own)], gradient[np.ix_(rows, own)][:, :, None])[:, :, 0]
    reach = 2 * np.sqrt(np.maximum((step * gradient).sum(axis=1), 1e-18) / np.maximum(bend, 1e-9))
    step *= (relaxation * np.log1p(reach) / reach)[:, None]
    return np.where(still, x, np.maximum(least, x + np.clip(step, -MOST_STEP, MOST_STEP))), np.abs(gradient)


def sums_of(weights: np.ndarray, place: np.ndarray, n: int, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per place the sums of weights * gap, of the upper half of weights x weights * p (1 - p),
    and of p (1 - p)."""
    gap, bend = y - p, p * (1 - p)
    m = len(weights)
    total = lambda w: np.bincount(place, w, n)
    rows = [total(w * gap) for w in weights]
    rows += [total(weights[a] * weights[b] * bend) for a in range(m) for b in range(a, m)]
    rows.append(total(bend))
    return np.array(rows)


def full(upper: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((upper.shape[1], m, m))
    a, b = np.triu_indices(m)
    out[:, a, b] = upper.T
    out[:, b, a] = upper.T
    return out


def answer_probability(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass(frozen=True)
class Shape:
    """How payloads are laid out: items hold masks and (a, d), takers abilities."""
    models: int
    k: int

    def item(self, data: bytes) -> np.ndarray:                  # models x (q, a, d) x places
        return np.frombuffer(data).reshape(self.models, 2 * self.k + 1, -1)

    def taker(self, data: bytes) -> np.ndarray:                 # models x k x places
        return np.frombuffer(data).reshape(self.models, self.k, -1)


    def sent(self, data: bytes) -> bytes:
        """An item block as it is sent to its tiles: masks as bytes, then a where the mask is
        not 0, then d; masked entries of a are 0."""
        items = self.item(data)
        q, k = items[:, :self.k], self.k
        if not np.isin(q, (0.0, 1.0)).all():
            raise ValueError("masks are 0 or 1")
        return b"".join([np.int64(items.shape[2]).tobytes(), q.astype("u1").tobytes(), items[:, k:2 * k][q != 0].tobytes(),
                         items[:, 2 * k].tobytes()])

    def received(self, data: bytes) -> np.ndarray:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        size = self.models * self.k * n
        q = np.frombuffer(data, "u1", size, 8).reshape(self.models, self.k, n)
        values = np.frombuffer(data[8 + size:])
        out = np.zeros((self.models, 2 * self.k + 1, n))
        out[:, :self.k] = q
        a = np.zeros(q.shape)
        a[q != 0] = values[:len(values) - self.models * n]
        out[:, self.k:2 * self.k] = a
        out[:, 2 * self.k] = values[len(values) - self.models * n:].reshape(self.models, n)
        return out


def cells_of(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of items and takers and the answers of a tile, packed or as a list."""
    if pa.types.is_binary(column.type):
        data = column[row].as_buffer()
        n = data.size // 16
        return np.frombuffer(data, "<i4", n, 8 * n), np.frombuffer(data, "<i4", n, 12 * n), np.frombuffer(data, "<f8", n)
    cells = column[row].values
    i, t, y = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("i", "t", "y"))
    return i, t, y


def by_mask(q: np.ndarray, *cells: np.ndarray):
    """The cells (item places first) by the mask of their item: its dimensions, and the cells."""
    bits = (q != 0).T @ (1 << np.arange(len(q)))
    found, code = np.unique(bits, return_inverse=True)
    own = [np.flatnonzero(b >> np.arange(len(q)) & 1) for b in found]
    if len(found) == 1:
        yield own[0], cells
        return
    code = code.astype("u2" if len(found) < 1 << 16 else "i8")[cells[0]]
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(found)))
    for dims, first, last in zip(own, [0, *ends], ends):
        if last > first:
            yield dims, tuple(x[order[first:last]] for x in cells)


def sum_rows_of(at: np.ndarray, m: int) -> np.ndarray:
    """Rows of ``sums_of`` for ``m`` weights that hold the sums of those ``at`` alone."""
    a, b = (at[x] for x in np.triu_indices(len(at)))
    return np.concatenate([at, m + a * m - a * (a - 1) // 2 + b - a, [m + m * (m + 1) // 2]])


def products_of(weights: np.ndarray) -> np.ndarray:
    """Weights (rows), the upper half of their products with each other, and 1."""
    a, b = np.triu_indices(len(weights))
    return np.vstack([weights, weights[a] * weights[b], np.ones((1, weights.shape[1]))])


def placed_sums(slope: np.ndarray, ability: np.ndarray, d: np.ndarray, side: str, i: np.ndarray, t: np.ndarray,
                y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """What ``sums_of`` gives and the log-likelihood.  Products of weights are formed per item
    or taker, not per cell; cells that lie in the order of their places are added up in chunks."""
    table = products_of(np.vstack([ability, -np.ones((1, ability.shape[1]))]) if side == "item" else slope)
    m = len(slope) + (side == "item")
    slope, ability = np.ascontiguousarray(slope.T), np.ascontiguousarray(ability.T)
    place = i if side == "item" else t
    ordered = bool((place[1:] >= place[:-1]).all())
    out, told, step = np.zeros((len(table), n)), 0.0, max(1024, CHUNK // len(table)) if ordered else max(1, len(i))
    for c in range(0, len(i), step):
        ip, tp, yp = i[c:c + step], t[c:c + step], y[c:c + step]
        z = np.einsum("ij,ij->i", slope.take(ip, axis=0), ability.take(tp, axis=0)) - d.take(ip)
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, 1.0, e) / (1.0 + e)
        told -= float((np.log(1.0 + e) + np.maximum(np.where(yp > 0, -z, z), 0.0)).sum())
        place, other = (ip, tp) if side == "item" else (tp, ip)
        sums = table.take(other, axis=1)
        sums[:m] *= yp - p
        sums[m:] *= p * (1 - p)
        if ordered:
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            out[:, place[first]] += np.add.reduceat(sums, first, axis=1)
        else:
            out = np.array([np.bincount(place, w, n) for w in sums])
    return out, told


def tile_sums(k: int, active: tuple[int, ...], side: str, items: np.ndarray, takers: np.ndarray, i: np.ndarray,
              t: np.ndarray, y: np.ndarray, by_taker: np.ndarray | None, used_by: dict[int, list[int]] | None) -> list[np.ndarray]:
    """Cells per place and, model by model, the sums of a tile; the models' log-likelihoods.
    ``by_taker``: the cells' order by taker, if known; ``used_by``: a model's dimensions,
    those of the tile's items if not given."""
    place, n = (i, items.shape[2]) if side == "item" else (t, takers.shape[2])
    if side == "taker" and by_taker is not None and items[list(active), :k].sum(axis=1).max(initial=0) > NARROW:
        i, t, y, place = i[by_taker], t[by_taker], y[by_taker], place[by_taker]
    parts, ll = [np.bincount(place, minlength=n).astype("f8")], []
    for m in active:
        q, a, d = items[m, :k], items[m, k:2 * k], items[m, 2 * k]
        used = np.flatnonzero(q.any(axis=1)) if used_by is None else np.array(used_by[m], int)
        size = len(used) + (side == "item")
        sums, told = np.zeros((size + size * (size + 1) // 2 + 1, n)), 0.0
        for own, cells in by_mask(q[used], i, t, y):        # dimensions that are masked add nothing
            found, part = placed_sums(a[used[own]], takers[m][used[own]], d, side, *cells, n)
            sums[sum_rows_of(np.append(own, len(used)) if side == "item" else own, size)] += found
            told += part
        ll.append(told)
        parts.append(sums.ravel())
    return [np.concatenate(parts), np.array(ll)]


def block_sums(shape: Shape, active: tuple[int, ...], side: str, tiles, used_by: dict[int, list[int]] | None = None):
    """Block, sums and log-likelihoods over tiles (ib, tb, item and taker parameters, places,
    answers and order of the cells); those of one block are added up as long as the task holds few enough."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0
    for ib, tb, items, takers, cells in tiles:
        part = tile_sums(shape.k, active, side, items, takers, *cells, used_by)
        block = ib if side == "item" else tb
        if block in held:
            for total, x in zip(held[block], part):
                total += x
            continue
        held[block] = part
        size += part[0].nbytes
        if size > HELD_BYTES:
            yield from ((b, *x) for b, x in held.items())
            held, size = {}, 0
    yield from ((b, *x) for b, x in held.items())


def partial_sums(shape: Shape, active: tuple[int, ...], side: str, sent: bool = False):
    """``block_sums`` for mapInArrow over tiles joined with the parameters of their two
    blocks (items in the form that is ``sent``, if so)."""
    item_block = shape.received if sent else shape.item

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield (batch.column("ib")[row].as_py(), batch.column("tb")[row].as_py(), item_block(batch.column("item_payload")[row].as_py()),
                       shape.taker(batch.column("taker_payload")[row].as_py()), (*cells_of(batch.column("cells"), row), None))

    def run(batches):
        for block, sums, ll in block_sums(shape, active, side, read(batches)):
            yield from sum_rows({block: [sums, ll]})
    return run


def sum_rows(held: dict[int, list[np.ndarray]]):
    for block, (sums, ll) in held.items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([False]), pa.array([sums.tobytes()], pa.binary()),
                               pa.array([ll.tolist()], pa.list_(pa.float64()))], names=["block", "own", "payload", "ll"])


def added_sums(batches):
    """For mapInArrow over sums dealt by block: one row per block, added up as they come."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            block = batch.column("block")[r].as_py()
            part = [np.frombuffer(batch.column("payload")[r].as_py()), np.array(batch.column("ll")[r].as_py())]
            if block in held:
                for total, x in zip(held[block], part):
                    total += x
            else:
                held[block] = [x.copy() for x in part]
    yield from sum_rows(held)


def moved_block(shape: Shape, active: tuple[int, ...], side: str, ridge: float, least: float | None, used_by: dict[int, list[int]],
                relaxation: float, payload: bytes, total: np.ndarray | None, told: np.ndarray | None) -> tuple[bytes, list, list]:
    """A block's parameters after a step by the sums of its tiles, log-likelihoods and gaps."""
    k = shape.k
    state = (shape.item if side == "item" else shape.taker)(payload).copy()
    n = state.shape[2]
    ll, gap = np.full(shape.models, np.nan), np.full(shape.models, np.nan)
    if told is not None:
        ll[list(active)] = told
    at = n
    for m in active:
        used = np.array(used_by[m], int)
        size = len(used) + (side == "item")
        rows = size + size * (size + 1) // 2 + 1
        part = np.zeros((rows, n)) if total is None else total[at:at + rows * n].reshape(rows, n)
        at += rows * n
        gradient, curvature = part[:size].T.copy(), full(part[size:-1], size)
        curvature[:, np.arange(size), np.arange(size)] += ridge
        if side == "item":
            x = np.vstack([state[m, k + used], state[m, 2 * k:]]).T.copy()
            free = np.vstack([state[m, used] > 0, np.ones((1, n), bool)]).T
            centre = np.append(np.ones(len(used)), 0.0)
            low = np.append(np.full(len(used), least), -np.inf)
        else:
            x, free = state[m, used].T.copy(), np.ones((n, size), bool)
            centre, low = np.zeros(size), np.full(size, -np.inf if least is None else least)
        moved, left = newton(x, np.broadcast_to(low, x.shape), gradient + ridge * (centre - x), curvature, free,
                             part[-1], relaxation)
        count = np.zeros(n) if total is None else total[:n]
        gap[m] = (left.max(axis=1, initial=0.0) / (1.0 + count)).max(initial=0.0)
        if side == "item":
            state[m, k + used], state[m, 2 * k] = moved[:, :-1].T * (state[m, used] > 0), moved[:, -1]
        else:
            state[m, used] = moved.T
    return state.tobytes(), ll.tolist(), gap.tolist()


def packed_blocks(rows: DataFrame, places: DataFrame, key: str, columns: list[str], models: list[int]) -> DataFrame:
    """One payload per block: models x columns x places; missing rows are 0."""
    def pack(group: pa.Table) -> pa.Table:
        place = group.column("place").to_numpy()
        out = np.zeros((len(models), len(columns), int(place.max()) + 1))
        model = np.searchsorted(models, group.column("model").to_numpy())
        for c, name in enumerate(columns):
            out[model, c, place] = group.column(name).to_numpy()
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "payload": pa.array([out.tobytes()], pa.binary())})

    placed = rows.join(places, key).select("block", "place", F.col("model").cast("long").alias("model"),
                                           *[F.col(c).cast("double").alias(c) for c in columns])
    return cut_lineage(placed.groupBy("block").applyInArrow(pack, "block int, payload binary"), "state")


def unpacked_blocks(state: DataFrame, places: DataFrame, key: str, columns: list[str], models: list[int]) -> DataFrame:
    """model, key and columns again."""
    def unpack(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("payload")):
                values = np.frombuffer(data.as_py()).reshape(len(models), len(columns), -1)
                n = values.shape[2]
                yield pa.record_batch(
                    [pa.array(np.full(len(models) * n, block, "i4")), pa.array(np.tile(np.arange(n, dtype="i4"), len(models))),
                     pa.array(np.repeat(np.array(models, "i4"), n)), *(pa.array(values[:, c].ravel()) for c in range(len(columns)))],
                    names=["block", "place", "model", *columns])

    fields = "block int, place int, model int, " + ", ".join(f"{c} double" for c in columns)
    rows = state.select("block", "payload").mapInArrow(unpack, fields)
    return cut_lineage(rows.join(places, ["block", "place"]).select("model", key, *columns), "fitted")


# --- steps -----------------------------------------------------------------

@dataclass(frozen=True)
class Kept:
    """Tiles in their parts, the number of parts, and which parts need an item or taker block."""
    rows: RDD
    parts: int
    item: dict[int, list[int]]
    taker: dict[int, list[int]]


def kept_tiles(table: DataFrame) -> Kept:
    """Stored tiles, dealt to parts of about equal cells; neighbours share their item block.
    Only the numbers and sizes of the tiles reach the driver."""
    sizes = sorted((r["ib"], r["tb"], r["n"]) for r in table.select("ib", "tb", F.length("cells").alias("n")).collect())
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(len(sizes), cores * max(1, len(sizes) // (cores * PART_TILES))))
    cells, before, part = max(1, sum(n for _, _, n in sizes)), 0, {}
    for ib, tb, n in sizes:
        part[ib, tb] = min(parts - 1, (2 * before + n) * parts // (2 * cells))
        before += n
    needed: tuple[dict, dict] = {}, {}
    for blocks, found in part.items():
        for at, block in zip(needed, blocks):
            at.setdefault(block, set()).add(found)

    def placed(row):
        n = len(row["cells"]) // 16
        y, i, t = (np.frombuffer(row["cells"], kind, n, first * n) for kind, first in (("<f8", 0), ("<i4", 8), ("<i4", 12)))
        if ((y == 0) | (y == 1)).all():
            y = y.astype("u1")
        return (part[row["ib"], row["tb"]], row["ib"], row["tb"]), (i, t, y, np.argsort(t, kind="stable").astype("i4"))
    rows = dealt(table.select("ib", "tb", "cells").rdd.map(placed), parts)
    return Kept(rows, parts, *({b: sorted(x) for b, x in at.items()} for at in needed))


def kept_state(state: DataFrame) -> RDD:
    """Per block its parameters, log-likelihoods and gaps, dealt by block."""
    parts = max(1, min(state.count(), state.sparkSession.sparkContext.defaultParallelism))
    return dealt(state.select("block", "payload").rdd.map(lambda r: ((r["block"],), (bytes(r["payload"]), [], []))), parts)


def sent(tiles: Kept, state: RDD, shape: Shape, side: str) -> RDD:
    """The parameters of one side's blocks, at the parts that need them."""
    needed = tiles.item if side == "item" else tiles.taker

    def told(row):
        if row[0][0] in needed:
            data = shape.sent(row[1][0]) if side == "item" else row[1][0]
            for part in needed[row[0][0]]:
                yield (part, side, row[0][0]), data
    return state.flatMap(told).partitionBy(tiles.parts, own_part)


def step(tiles: Kept, own: RDD, items: RDD, takers: RDD, shape: Shape, active: tuple[int, ...], side: str, ridge: float,
         least: float | None, used_by: dict[int, list[int]], relaxation: float = 1.0) -> RDD:
    """The state of one side's blocks (``own``) after a step; only parameters (``items`` and
    ``takers`` as ``sent``) and sums are shuffled."""
    def with_parameters(rows):
        held, last, item = {}, None, None
        for (_, ib, tb), value in rows:         # parameters come first
            if isinstance(ib, str):
                held[ib, tb] = value
                continue
            if ib != last:
                last, item = ib, shape.received(held["item", ib])
            yield ib, tb, item, shape.taker(held["taker", tb]), value

    def added(rows):
        payloads, block, total, told = {}, None, None, None

        def moved():
            return (block,), moved_block(shape, active, side, ridge, least, used_by, relaxation, payloads.pop(block), total, told)
        for key, value in rows:                 # the blocks' own parameters come first, then sums by block
            if len(key) == 1:
                payloads[key[0]] = value[0]
                continue
            if key[0] != block:
                if block is not None:
                    yield moved()
                block, total, told = key[0], *(x.copy() for x in value)
                continue
            total += value[0]
            told += value[1]
        if block is not None:
            yield moved()
        total, told = None, None
        for block in list(payloads):
            yield moved()

    sums = items.union(takers).union(tiles.rows).mapPartitions(
        lambda rows: (((b, "sums"), x) for b, *x in block_sums(shape, active, side, with_parameters(rows), used_by)))
    sums = sums.repartitionAndSortWithinPartitions(own.getNumPartitions(), own_part)
    return own.union(sums).mapPartitions(added, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)


def progress(items: RDD | None, takers: RDD) -> tuple[dict[int, float], dict[int, float]]:
    """Per model the log-likelihood before the takers' step, and the largest gap of the
    states; of all states in one job, some numbers per block and model."""
    told = takers.map(lambda row: (True, *row[1][1:]))
    if items is not None:
        told = told.union(items.map(lambda row: (False, *row[1][1:])))
    now: dict[int, float] = {}
    gaps: dict[int, float] = {}
    for counts, ll, gap in told.collect():
        for m, (x, g) in enumerate(zip(ll, gap)):
            if not np.isnan(g):
                now[m] = now.get(m, 0.0) + (x if counts and not np.isnan(x) else 0.0)
                gaps[m] = max(gaps.get(m, 0.0), g)
    return now, gaps

"""Cross-product sums over the columns of a long table.

Rows are packed (one list per row), every task adds up the cross products of
its own rows with NumPy, and the partial matrices are added by matrix row.  No
pair of cells is ever emitted, so a hot row or column costs no extra shuffle.
The column count is bounded and checked; the row count is not bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 2000
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def column_labels(cells: DataFrame, column: str, value: str | None = None,
                  limit: int = MAX_COLUMNS) -> tuple[list, list[float]]:
    """Sorted labels and mean values of the columns, on the driver (checked size)."""
    mean = F.lit(0.0) if value is None else F.avg(value)
    rows = cells.groupBy(column).agg(mean.alias("m")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values of {column}")
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], [r[1] or 0.0 for r in rows]


def pack(cells: DataFrame, row: str, column: str, value: str, labels: list,
         shifts: list[float] | None = None) -> DataFrame:
    """One row per ``row`` key: positions of its columns and their values."""
    kind = cells.schema[column].dataType.simpleString()
    index = cells.sparkSession.createDataFrame(
        [(x, i, float(s)) for i, (x, s) in enumerate(zip(labels, shifts or [0.0] * len(labels)))],
        f"{column} {kind}, _at int, _shift double")
    entry = F.struct("_at", (F.col(value).cast("double") - F.col("_shift")).alias("v"))
    # `labels` passed the size check, so the index may be broadcast
    return (cells.filter(F.col(value).isNotNull()).join(F.broadcast(index), column)
            .groupBy(row).agg(F.collect_list(entry).alias("_cells"))
            .select(row, F.col("_cells._at").alias("at"), F.col("_cells.v").alias("v")))


def _dense(at: pa.ListArray, values: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(at.offsets.to_numpy())
    rows = np.repeat(np.arange(len(at)), counts)
    columns = at.flatten().to_numpy()
    x = np.zeros((len(at), width))
    present = np.zeros((len(at), width))
    x[rows, columns] = values.flatten().to_numpy()
    present[rows, columns] = 1.0
    return x, present


def _matrix_rows(names: list[str], sums: list[np.ndarray], width: int, step: int = 256):
    for start in range(0, width, step):
        stop = min(start + step, width)
        arrays = [pa.array(np.arange(start, stop, dtype=np.int32))]
        arrays += [pa.FixedSizeListArray.from_arrays(pa.array(s[start:stop].ravel()), s.shape[1])
                   .cast(pa.list_(pa.float64())) for s in sums]
        yield pa.RecordBatch.from_arrays(arrays, names=["i"] + names)


def _added(partials: DataFrame, names: list[str]) -> DataFrame:
    """Add partial matrices by row number."""
    def add(batches):
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy()
            parts = [c.flatten().to_numpy().reshape(len(keys), -1) if len(keys) else None
                     for c in batch.columns[1:]]
            for at, i in enumerate(keys):
                held = totals.get(int(i))
                if held is None:
                    totals[int(i)] = [p[at].copy() for p in parts]
                else:
                    for h, p in zip(held, parts):
                        h += p[at]
        if totals:
            arrays = [pa.array(list(totals), pa.int32())]
            arrays += [pa.array([t[k] for t in totals.values()], pa.list_(pa.float64()))
                       for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=["i"] + names)
    return partials.repartition("i").mapInArrow(add, partials.schema)


def _schema(names):
    return "i int, " + ", ".join(f"{n} array<double>" for n in names)


def gram(packed: DataFrame, width: int, step: int = 2_000_000) -> DataFrame:
    """Rows ``i`` of X'X (column ``g``), absent cells counting as 0."""
    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            at, v = batch.column("at"), batch.column("v")
            size = max(1, step // width)
            for start in range(0, len(at), size):
                x, _ = _dense(at.slice(start, size), v.slice(start, size), width)
                total += x.T @ x
        yield from _matrix_rows(["g"], [total], width)
    return _added(packed.select("at", "v").mapInArrow(partial, _schema(["g"])), ["g"])


def dense_gram(vectors: DataFrame, width: int) -> DataFrame:
    """Rows of V'V for a dense array column ``v`` of ``width`` values."""
    return grouped_gram(vectors.select(F.lit(0).alias("part"), "v"), width).drop("part")


def grouped_gram(vectors: DataFrame, width: int) -> DataFrame:
    """Rows of V'V per small integer ``part``: part, i, g.  Each task keeps one matrix
    per part it meets."""
    def partial(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            parts = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for part in np.unique(parts):
                own = x[parts == part]
                totals[int(part)] = totals.get(int(part), 0.0) + own.T @ own
        for part, total in totals.items():
            for rows in _matrix_rows(["g"], [total], width):
                shifted = pa.array(rows.column(0).to_numpy() + np.int32(part * width), pa.int32())
                yield pa.RecordBatch.from_arrays([shifted, rows.column(1)], names=["i", "g"])
    table = vectors.select(F.col("part").cast("int").alias("part"), "v")
    summed = _added(table.mapInArrow(partial, _schema(["g"])), ["g"])
    return summed.select(F.expr(f"i div {width}").cast("int").alias("part"),
                         (F.col("i") % width).alias("i"), "g")


def pair_sums(packed: DataFrame, width: int, step: int = 1_000_000) -> DataFrame:
    """Per column ``i`` arrays over all columns j of the pairwise-complete sums."""
    def partial(batches):
        totals = [np.zeros((width, width)) for _ in _SUMS]
        for batch in batches:
            at, v = batch.column("at"), batch.column("v")
            size = max(1, step // width)
            for start in range(0, len(at), size):
                x, m = _dense(at.slice(start, size), v.slice(start, size), width)
                x2 = x * x
                for total, (a, b) in zip(totals, ((m, m), (x, m), (m, x), (x2, m), (m, x2), (x, x))):
                    total += a.T @ b
        yield from _matrix_rows(_SUMS, totals, width)
    return _added(packed.select("at", "v").mapInArrow(partial, _schema(_SUMS)), _SUMS)


def pair_table(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Long table of the sums: v1, v2, n, sx, sy, sxx, syy, sxy (values shifted by
    the column mean, which leaves covariances unchanged and keeps them accurate).
    ``cells`` is read twice, so pass a stored table."""
    labels, shifts = column_labels(cells, column, value)
    sums = pair_sums(pack(cells, row, column, value, labels, shifts), len(labels))
    kind = cells.schema[column].dataType.simpleString()
    names = cells.sparkSession.createDataFrame(
        list(enumerate(labels)), f"i int, label {kind}")
    zipped = sums.select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "s"))
    first = F.broadcast(names.withColumnRenamed("label", "v1"))
    second = F.broadcast(names.select(F.col("i").alias("j"), F.col("label").alias("v2")))
    return zipped.join(first, "i").join(second, "j").select("v1", "v2", "s.*")


def collect_matrix(rows: DataFrame, width: int, name: str = "g",
                   limit: int = MAX_COLUMNS) -> np.ndarray:
    """A matrix of checked size on the driver."""
    if width > limit:
        raise ValueError(f"matrix side {width} is above {limit}")
    out = np.zeros((width, width))
    for r in rows.select("i", name).collect():
        out[r[0]] = r[1]
    return out

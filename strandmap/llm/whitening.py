"""Whitening of embeddings by a tiled covariance.

Dimensions are cut into blocks, and every pair of blocks is a tile of the
covariance matrix. Rows are cut into row-blocks; the column blocks of a
row-block are shuffled to the tiles that need them, where the two blocks of a
tile are centred and multiplied. Products are summed tile by tile, the upper
triangle is assembled, and its leading eigenvectors whiten the vectors. No task
holds more than two blocks and the sums of its tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm.common import free_name, lean, ship, stored
from strandmap.llm.vectors import matrix, runs

#: Rows of a row-block; column blocks of a row at most, and their least width: a block is copied once for each of them.
ROWS, BLOCKS, LEAST_BLOCK = 4096, 4, 32
#: Tasks that sum a tile before its last sum.
SPREAD = 8
_TOP = np.float64(2**63 - 1024)


@dataclass
class Whitener:
    n: int  # vectors of the fit list
    sums: np.ndarray  # of each dimension, long
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # a column for each of them
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def projection(self) -> np.ndarray:
        """A column for each component; nan where the vectors do not vary."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.vectors / np.sqrt(np.maximum(self.values, 0)), np.nan)


def quantised(vectors: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, scale: int = 256) -> DataFrame:
    """Columns ``keep`` (all if None) and x: the entries times ``scale``, rounded down, as little-endian longs.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    An entry beyond the range of a long takes the end of the range.
    """
    ship(vectors.sparkSession)
    keep = vectors.columns if keep is None else keep
    name = free_name(vectors, "x")
    schema = T.StructType([vectors.schema[c] for c in keep]).add(name, "binary")

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            lists = pa.concat_arrays([column]) if isinstance(column, pa.Array) else column.combine_chunks()
            lengths = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = np.asarray(lists.is_valid()) & (bad[ends] == bad[ends - lengths])
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.clip(np.floor(np.nan_to_num(values) * scale), -_TOP, _TOP).astype("<i8")
            packed = pa.array([x[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends.tolist(), lengths.tolist(), fine.tolist(), strict=True)], pa.binary())
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), packed], names=[*keep, name])
            yield out.filter(pa.array(fine))

    return vectors.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{vector_col}`").cast("array<double>").alias("_v")).mapInArrow(lean(run), schema)


def _rows(column, width: int) -> np.ndarray:
    """Packed longs of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def fit_list(x: DataFrame, column: str = "x") -> tuple[DataFrame, int, int]:
    """Each distinct vector once, stored, with their width and number.

    Vectors of a table should have one width. Where they don't, the width of
    most distinct vectors counts, the smaller of equals, and the others are left
    out; vectors without entries are left out too. (Width 0 and number 0 if none is left.)
    """
    distinct = stored(x.select(F.col(column).alias("x")).where(F.length("x") > 0).distinct(), "whitening-fit")
    widths = distinct.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(1).collect()
    if not widths:
        return distinct, 0, 0
    return distinct.where(F.length("x") == widths[0].bytes), widths[0].bytes // 8, widths[0]["count"]


def column_sums(fit: DataFrame, width: int) -> np.ndarray:
    """Exact sums of each dimension: longs in a task, decimals of 38 digits over all."""

    def run(batches):
        total = [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _rows(batch.column(0).slice(at, ROWS), width)
                # Halves of a long can't overflow in a sum of some thousand rows.
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(b) for t, h, b in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total])], names=["dim", "s"])

    parts = fit.select("x").mapInArrow(lean(run), "dim int, s string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    out = [0] * width
    for r in rows:
        out[r.dim] = int(r.s)
    return np.array(out, object)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return np.ascontiguousarray(x, "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")


def _blocks(width: int, block: int):
    """Cut rows into column blocks, one for each tile that needs it: (tile, task and row_block, side, n_rows, x of the block)."""
    n = -(-width // block)

    def run(batches):
        task, at = None, 0
        for batch in batches:
            task = batch.column(1)[0].as_py() if batch.num_rows else task
            for first in range(0, batch.num_rows, ROWS):
                x = _rows(batch.column(0).slice(first, ROWS), width)
                tiles, sides, data = [], [], []
                for i in range(n):
                    part = _narrow(x[:, i * block : (i + 1) * block]).tobytes()
                    for j in range(n):
                        a, b = min(i, j), max(i, j)
                        tiles.append(a * n + b)
                        sides.append(int(i > j))
                        data.append(part)
                k = len(tiles)
                ints = [pa.array(c, pa.int32()) for c in (tiles, [task] * k, [at] * k, sides, [len(x)] * k)]
                yield pa.RecordBatch.from_arrays([*ints, pa.array(data, pa.binary())], names=["tile", "task", "row_block", "side", "n_rows", "x"])
                at += 1

    return run


def _products(width: int, block: int, mean: np.ndarray):
    """Sums of products of the two blocks of each tile, centred before they are multiplied."""
    n = -(-width // block)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        now = None
        for (tile, _, _), rows in runs(batches, ["tile", "task", "row_block"]):
            if now is not None and tile != now:
                yield _tile_batch(now, sums.pop(now))
            now = tile
            i, j = divmod(int(tile), n)
            n_rows = rows.column("n_rows")[0].as_py()
            sides = dict(zip(rows.column("side").to_pylist(), rows.column("x").to_pylist(), strict=True))
            centred = []
            for side, k in ((0, i), (1, j)):
                part = mean[k * block : (k + 1) * block]
                data = sides.get(side, sides[0])
                size = len(data) // (n_rows * len(part))
                centred.append(np.frombuffer(data, f"<i{size}").reshape(n_rows, len(part)) - part)
            product = centred[0].T @ centred[1]
            sums[tile] = sums[tile] + product if tile in sums else product
        if now is not None:
            yield _tile_batch(now, sums.pop(now))

    return run


def _tile_batch(tile: int, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([s.astype("<f8").tobytes()], pa.binary())], names=["tile", "s"])


def _added(batches):
    """Sum the partial tiles of a task, which come sorted by tile."""
    for (tile,), rows in runs(batches, ["tile"]):
        yield _tile_batch(tile, sum(np.frombuffer(s.as_py(), "<f8") for s in rows.column("s")))


def covariance(fit: DataFrame, width: int, n: int, sums: np.ndarray, block: int | None = None) -> np.ndarray:
    """The covariance of the fit list, divisor n.

    Column blocks have ``block`` dimensions: a quarter of all, 32 at least, unless told. The fit list has to be stored, so that a row-block has the same rows whenever it is read.
    """
    block = block or max(LEAST_BLOCK, -(-width // BLOCKS))
    cuts = -(-width // block)
    mean = np.array([s / n for s in sums.tolist()], float)
    blocks = fit.select("x", F.spark_partition_id().alias("task")).mapInArrow(lean(_blocks(width, block)), "tile int, task int, row_block int, side int, n_rows int, x binary")
    met = blocks.repartition("tile", "task", "row_block").sortWithinPartitions("tile", "task", "row_block", "side")
    partial = met.mapInArrow(lean(_products(width, block, mean)), "tile int, s binary")
    first = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD))).repartition("tile", "salt").sortWithinPartitions("tile").select("tile", "s").mapInArrow(lean(_added), "tile int, s binary")
    tiles = first.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(_added), "tile int, s binary")
    out = np.zeros((width, width))
    for r in tiles.toLocalIterator():  # one row a tile: the matrix, however many vectors there are
        i, j = divmod(r.tile, cuts)
        a, b = slice(i * block, min(width, (i + 1) * block)), slice(j * block, min(width, (j + 1) * block))
        out[a, b] = np.frombuffer(r.s, "<f8").reshape(a.stop - a.start, b.stop - b.start) / n
        out[b, a] = out[a, b].T
    return out


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and unit eigenvectors; values that rounding alone makes are zero."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    values = values[order]
    noise = len(v) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    return np.where(values > noise, values, 0.0), vectors[:, order]


def fit(x: DataFrame, components: int = 4, block: int | None = None, column: str = "x") -> tuple[Whitener | None, DataFrame]:
    """Whitener of the distinct vectors of ``x`` (see ``quantised``), and these; no whitener if there are none."""
    distinct, width, n = fit_list(x, column)
    if not n:
        return None, distinct
    sums = column_sums(distinct, width)
    v = covariance(distinct, width, n, sums, block)
    values, vectors = eigen(v, min(components, width))
    return Whitener(n, sums, values, vectors, float(np.trace(v))), distinct


def identity_error(distinct: DataFrame, w: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, over the components that vary; 0 if none does."""
    use = w.values > 0
    k = int(use.sum())
    if not k:
        return 0.0
    width, projection, mean = w.width, w.projection()[:, use], _mean(w)

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                z = (_rows(batch.column(0).slice(at, ROWS), width) - mean) @ projection
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "s"])

    cells = distinct.select("x").mapInArrow(lean(run), "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    total = np.zeros((k + 1) * k)
    for r in cells.collect():  # a cell for each pair of components
        total[r.cell] = r.s
    total = total.reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _mean(w: Whitener) -> np.ndarray:
    return np.array([s / w.n for s in w.sums.tolist()], float)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - sum) squared; null where a long can't hold one."""
    far = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums.tolist()))
    if len(sums) * far * far < 2**62:
        d = n * x - sums.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - sums
    return [s if s < 2**63 else None for s in (d * d).sum(axis=1).tolist()]


def whiten(x: DataFrame, w: Whitener, error: float, keep: list[str], column: str = "x") -> DataFrame:
    """Columns ``keep`` of ``x``, and for each row and component: component, n, deviation, whitened, explained, identity_error.

    Rows of another width than the whitener's are left out. whitened is null for
    a component in which the fit list does not vary, deviation where a long
    can't hold it. Columns of the new names are replaced.
    """
    k, width, n, sums = len(w.values), w.width, w.n, w.sums
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    keep = [c for c in keep if c.lower() not in names]
    schema = T.StructType([x.schema[c] for c in keep])
    for name, kind in zip(names, ["integer", "long", "long", "double", "double", "double"], strict=True):
        schema = schema.add(name, kind)
    projection, mean = w.projection(), _mean(w)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.equal(pa.compute.binary_length(batch.column(len(keep))), 8 * width))
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                part = _rows(rows.column(len(keep)), width)
                z = (part - mean) @ projection
                each = np.repeat(np.arange(len(part)), k)
                columns = [rows.column(i).take(pa.array(each)) for i in range(len(keep))]
                z = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                deviation = pa.array(_deviations(part, n, sums), pa.int64()).take(pa.array(each))
                columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(each), n, np.int64)), deviation, z, pa.array(np.tile(explained, len(part))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return x.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`").alias("_x")).mapInArrow(lean(run), schema)


def whitened(vectors: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, components: int = 4, block: int | None = None) -> DataFrame:
    """Fit on the distinct vectors, then whiten every row: see ``quantised``, ``fit`` and ``whiten``.

    Null ids and repeated rows stay. A table without usable vectors has no rows.
    """
    keep = [c for c in (vectors.columns if keep is None else keep) if c != vector_col]
    x = quantised(vectors, vector_col, keep)
    column = x.columns[-1]
    w, distinct = fit(x, components, block, column)
    if w is None:
        w = Whitener(1, np.zeros(1, object), np.zeros(1), np.ones((1, 1)), 0.0)
        return whiten(x.where(F.lit(False)), w, 0.0, keep, column)
    return whiten(x, w, identity_error(distinct, w), keep, column)

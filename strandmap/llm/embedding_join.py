"""Near-duplicate embeddings by an exact metric range join.

On the unit sphere a cosine of c is a distance of r = sqrt(2 - 2c). Pivots cut
the vectors into cells, each vector lives in the cell of its nearest pivot, and
a vector y is copied to the cell of another pivot p only where the triangle
inequality lets a vector within r live there: its distance to p may exceed the
cell's radius by r at most, and the distance to the plane half-way between p
and y's own pivot may be r at most. Cells then join on their own. A pair across
cells is met once, in the cell of the smaller pivot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.common import lean, meet, ship, stored
from strandmap.llm.graph import connected_components, forest
from strandmap.llm.vectors import matrix, runs, usable, width_of

#: Vectors of a cell on average, and pivots at most; pivots are fetched to the driver.
CELL, MOST_PIVOTS = 4096, 4096
#: Small tables get as many pivots as the root of their size, up to so many.
ROOT_PIVOTS = 16
#: Bytes of the vectors of crowds of copies that are broadcast at most.
CROWD_BYTES = 64_000_000
#: Vectors on a side of one block of work.
BLOCK = 4096
_SLACK = 1e-9
# A class of equal vectors: their smallest id, a hash that tells it from others with that id, their number, the vector.
_CLASS = ["rep", "h", "m", "v"]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, n: int) -> list[list[float]]:
    """Distinct vectors with the smallest hashes: the same choice in every run."""
    k = min(MOST_PIVOTS, max(math.ceil(n / CELL), min(ROOT_PIVOTS, round(math.sqrt(n))), 1))
    rows = classes.select("v", F.xxhash64("rep", "v").alias("h"), "rep").orderBy("h", "rep").limit(k).collect()
    return [r.v for r in rows]


def _padded(rows: list[list[float]], width: int) -> np.ndarray:
    return _unit(np.array([list(r[:width]) + [0.0] * max(0, width - len(r)) for r in rows]))


def _homes(pivots, width: int):
    def run(batches):
        p = _padded(pivots, width)
        for batch in batches:
            x = _unit(matrix(batch.column("v"), width)[0])
            cosines = x @ p.T
            home = cosines.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * cosines[np.arange(len(x)), home]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _CLASS), pa.array(home.astype(np.int64)), pa.array(far)], names=[*_CLASS, "home", "far"])

    return run


def _copies(pivots, width: int, reach: float, radii):
    """Each vector in its cell (own = 1) and, cut into blocks, in the cells of smaller pivots that its range may meet."""

    def run(batches):
        p = _padded(pivots, width)
        gap = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        for batch in batches:
            x = _unit(matrix(batch.column("v"), width)[0])
            home = batch.column("home").to_numpy()
            cosines = x @ p.T
            distance = np.sqrt(np.maximum(0, 2 - 2 * cosines))
            own = cosines[np.arange(len(x)), home][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (own - cosines) / gap[home]  # distance to the plane between the two pivots
            near = (distance <= radii + reach + _SLACK) & ((plane <= reach + _SLACK) | (gap[home] == 0)) & (np.arange(len(p)) < home[:, None])
            row, cell = np.nonzero(near)
            row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
            mark = np.concatenate([np.ones(len(x), np.int32), np.zeros(len(row) - len(x), np.int32)])
            for a in range(0, len(row), 20_000):
                r = pa.array(row[a : a + 20_000])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(r) for c in _CLASS), pa.array(cell[a : a + 20_000]), pa.array(mark[a : a + 20_000])], names=[*_CLASS, "cell", "own"])

    return run


def _cell_links(width: int, least: float):
    """Links of each block as counts by vector and a forest that connects the linked vectors."""

    def join(table: pa.Table, diagonal: bool):
        side = table["side"].to_numpy()
        raw, lengths = matrix(table["v"], width)
        norm = np.linalg.norm(raw, axis=1)
        unit = raw / norm[:, None]
        ids, h, m = (table[c].to_numpy() for c in ("rep", "h", "m"))
        left = np.flatnonzero(side == 0)
        right = left if diagonal else np.flatnonzero(side == 1)
        counts = np.zeros(len(ids), np.int64)
        a, b = [], []
        for i in range(0, len(left), 512):
            l_rows = left[i : i + 512]
            x, y = np.nonzero(unit[l_rows] @ unit[right].T >= least - _SLACK)
            x, y = l_rows[x], right[y]
            ok = (ids[x] < ids[y]) if diagonal else (ids[x] != ids[y])
            ok &= lengths[x] == lengths[y]
            x, y = x[ok], y[ok]
            for s in range(0, len(x), 100_000):
                u, w = x[s : s + 100_000], y[s : s + 100_000]
                exact = (raw[u] * raw[w]).sum(axis=1) / (norm[u] * norm[w]) >= least
                u, w = u[exact], w[exact]
                np.add.at(counts, u, m[w])
                np.add.at(counts, w, m[u])
                roots, members = forest(ids[u], ids[w])
                a.append(roots)
                b.append(members)
        return ids, h, counts, a, b

    def run(batches):
        for (_, x, y), table in runs(batches, ["cell", "x", "y"]):
            ids, h, counts, a, b = join(table, x == y and x >= 0)
            hit = counts > 0
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            a, b = forest(a, b)
            none = lambda n: [pa.nulls(n, pa.int64())]
            n = int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(h[hit]), pa.array(counts[hit]), *none(n) * 2], names=["rep", "h", "n", "a", "b"])
            yield pa.RecordBatch.from_arrays([*none(len(a)) * 3, pa.array(a), pa.array(b)], names=["rep", "h", "n", "a", "b"])

    return run


def _blocks(copies: DataFrame) -> DataFrame:
    """Deal each cell over blocks: pieces of its own vectors against each other and against pieces of the copies."""
    sizes = copies.groupBy("cell").agg(F.sum("own").alias("n_own"), F.sum(1 - F.col("own")).alias("n_copy"))
    sizes = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n_own") / BLOCK)).cast("long").alias("own_pieces"), F.ceil(F.col("n_copy") / BLOCK).cast("long").alias("copy_pieces"))
    rows = copies.join(sizes, "cell")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("rep", "h"), F.when(F.col("own") == 1, F.col("own_pieces")).otherwise(F.col("copy_pieces"))).cast("long"))
    seq = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    among = F.transform(seq(F.col("own_pieces")), lambda j: F.struct(F.least(j, F.col("piece")).alias("x"), F.greatest(j, F.col("piece")).alias("y"), F.when(j >= F.col("piece"), 0).otherwise(1).alias("side")))
    # y counts pieces of the copies from -1 downwards.
    against = F.when(F.col("copy_pieces") > 0, F.transform(seq(F.greatest(F.lit(1), F.col("copy_pieces"))), lambda j: F.struct(F.col("piece").alias("x"), (-1 - j).alias("y"), F.lit(0).alias("side")))).otherwise(F.slice(among, 1, 0))
    as_copy = F.transform(seq(F.col("own_pieces")), lambda i: F.struct(i.alias("x"), (-1 - F.col("piece")).alias("y"), F.lit(1).alias("side")))
    tiles = F.when(F.col("own") == 1, F.concat(among, against)).otherwise(as_copy)
    return rows.withColumn("t", F.explode(tiles)).select("cell", "t.x", "t.y", "t.side", *_CLASS)


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors``: its id, n_links, component_id and kept.

    Vectors are linked if their cosine in double precision is ``least`` or more.
    n_links counts the other vectors linked directly, component_id is the
    smallest id that links reach, kept marks it. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Rows that repeat an id count as one vector if
    their vectors are equal; otherwise they share one component, have the
    n_links of the vector with most, and don't link with each other. A null id
    has no links and a null component, and is kept. An empty table gives no rows. ``least`` lies
    above 0.

    Equal vectors fall together first and count with their number, so a crowd
    of copies costs one comparison. Vectors travel at the width they were read in.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = width_of((vectors, vector_col))
    rows = usable(vectors, id_col, vector_col, kind).distinct()
    # In one map from vectors to ids, so that copies meet in a partial aggregate.
    classes = stored(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("h", F.xxhash64("v")), "vector-classes")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    ids = vectors.select(F.col(f"`{id_col}`").cast("long").alias(id_col))
    if not shape.n:
        return _finished(ids, id_col, ids.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id")).limit(0))
    pivots = choose_pivots(classes, shape.n)
    width, reach = shape.width, math.sqrt(max(0.0, 2 - 2 * least))
    homed = stored(classes.select(*_CLASS).repartition(max(1, math.ceil(shape.n / 20_000)) * 2).mapInArrow(lean(_homes(pivots, width)), f"rep long, h long, m long, v array<{kind}>, home long, far double"), "homes")
    radii = np.full(len(pivots), -1.0)
    for r in homed.groupBy("home").agg(F.max("far").alias("far")).collect():  # a row for each pivot
        radii[r.home] = r.far
    copies = stored(homed.mapInArrow(lean(_copies(pivots, width, reach, radii)), f"rep long, h long, m long, v array<{kind}>, cell long, own int"), "copies")
    tiles = _blocks(copies).repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    found = stored(tiles.mapInArrow(lean(_cell_links(width, least)), "rep long, h long, n long, a long, b long"), "cell-links")
    counts = found.where("rep is not null").groupBy("rep", "h").agg(F.sum("n").alias("n"))
    # From here on a vector is known by the smallest id that has it.
    members = stored(meet(rows, classes, ["v"], "m", max(1, CROWD_BYTES // (8 * width))).select("id", "rep", "h"), "vector-members")
    groups = connected_components(found.where("a is not null").select("a", "b").unionByName(_repeats(members))).withColumnRenamed("node", "rep")
    per_class = classes.select("rep", "h", "m").join(counts, ["rep", "h"], "left").join(groups, "rep", "left")
    per_class = per_class.select("rep", "h", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    each = meet(members, stored(per_class, "vector-links"), ["rep", "h"], "m").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return _finished(ids, id_col, each)


def _finished(ids: DataFrame, id_col: str, each: DataFrame) -> DataFrame:
    """All rows with their links; rows without an id meet nothing in the join."""
    known = ids.where(F.col(id_col).isNotNull()).join(each.withColumnRenamed("id", id_col), id_col, "left")
    nameless = ids.where(F.col(id_col).isNull()).select(id_col, F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    component = F.coalesce("component_id", F.col(id_col))
    return known.unionByName(nameless).select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def _repeats(members: DataFrame) -> DataFrame:
    """Links (a, b) between the different vectors of a repeated id."""
    first = members.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("k")).where("k > 1")
    return members.join(first, "id").where("rep <> a").select("a", F.col("rep").alias("b"))

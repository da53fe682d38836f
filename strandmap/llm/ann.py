"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a neighbour graph, the graph is cut into balanced parts
with few cut edges, and a small network learns which parts hold a vector and
its neighbours. The network then places every row into its most probable part
and sends each query to its most probable parts, whose rows are reranked by
exact distance. How many parts a query visits is measured on queries that were
set aside before anything was fitted, so that the wanted recall is met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.common import lean, ship, stored
from strandmap.llm.vectors import matrix, runs, usable, width_of

#: Rows that fit the index for each part, and bounds on their number, whatever the size of the table.
ROWS_A_PART, LEAST_FIT, MOST_FIT = 64, 4096, 65_536
#: Bytes of the rows that fit the index, as doubles, on the driver.
FIT_BYTES = 256 * 1024 * 1024
#: Rows of a part on average, and bounds on the number of parts: small tables are cut into parts too.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 8, 1024
#: Candidates of one piece of a part.
PIECE = 4096
_GRAPH_NEIGHBOURS, _HELD_OUT, _LEAST_HELD = 10, 256, 16


@dataclass
class Router:
    """A network of one hidden layer over standardised vectors of one width."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, best first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def _nearest(x: np.ndarray, pool: np.ndarray, k: int, own: bool) -> np.ndarray:
    out = []
    for i in range(0, len(x), 512):
        d = (pool**2).sum(axis=1)[None] - 2 * x[i : i + 512] @ pool.T
        if own:
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(nodes: np.ndarray, neighbours: np.ndarray, x: np.ndarray, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes`` with few graph edges between them.

    The start is a cut at the median along the direction of most variance; the
    sweeps then swap equal numbers of nodes that gain most by changing sides.
    """
    local = np.full(len(x), -1)
    local[nodes] = np.arange(len(nodes))
    near = local[neighbours[nodes]]
    centred = x[nodes] - x[nodes].mean(axis=0)
    axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
    side = np.ones(len(nodes))
    side[np.argsort(centred @ axis, kind="stable")[: len(nodes) // 2]] = -1
    row, col = np.nonzero(near >= 0)
    a, b = row, near[row, col]

    def pull(s):
        out = np.zeros(len(s))
        np.add.at(out, a, s[b])
        np.add.at(out, b, s[a])
        return out

    for _ in range(sweeps):
        gain = -side * pull(side)
        low = np.flatnonzero(side < 0)
        high = np.flatnonzero(side > 0)
        low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
        n = min(len(low), len(high))
        good = int((gain[low[:n]] + gain[high[:n]] > 0).sum()) // 2
        if not good:
            break
        trial = side.copy()
        trial[low[:good]], trial[high[:good]] = 1, -1
        if (trial * pull(trial)).sum() <= (side * pull(side)).sum():
            break
        side = trial
    return nodes[side < 0], nodes[side > 0]


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, n_parts: int) -> np.ndarray:
    parts = [np.arange(len(x))]
    while len(parts) < n_parts:
        parts = [half for p in parts for half in bisect(p, neighbours, x)]
    label = np.zeros(len(x), int)
    for k, p in enumerate(parts):
        label[p] = k
    return label


def fit_router(x: np.ndarray, n_parts: int, recall: float, k: int, seed: int = 7) -> Router:
    """Fit on a sample ``x``; n_parts is a power of two, halved until a part has four rows of the sample.

    A quarter of the sample, ``_HELD_OUT`` rows at most, is set aside first: graph,
    parts and network never see it, and it tells how many parts a query visits.
    So a small sample has fewer parts, fitted all the same, down to two of two
    rows; three rows or fewer are one part. Fewer than ``_LEAST_HELD`` rows set
    aside tell too little, so all parts are visited, in the network's order.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    while n_parts > 2 and len(x) - len(x) // 4 < 4 * n_parts:
        n_parts //= 2
    if len(x) < 4:
        n_parts = 1
    aside = np.zeros(len(x), bool)
    aside[rng.choice(len(x), min(_HELD_OUT, len(x) // 4), replace=False)] = True
    held, x = x[aside], x[~aside]
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)) if len(x) else (np.zeros(width), np.ones(width))
    hidden = max(64, n_parts)
    router = Router(mean, scale, rng.normal(0, math.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, n_parts)), np.zeros(n_parts), n_parts)
    if n_parts == 1:  # nothing to route
        return router
    near = _nearest(x, x, min(_GRAPH_NEIGHBOURS, len(x) - 1), own=True)
    label = balanced_parts(x, near, n_parts)
    target = np.zeros((len(x), n_parts))
    target[np.arange(len(x)), label] = near.shape[1]
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    z = (x - mean) / scale
    weights = [router.w1, router.b1, router.w2, router.b2]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(25):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 256):
            rows = order[i : i + 256]
            h = np.maximum(0, z[rows] @ weights[0] + weights[1])
            s = h @ weights[2] + weights[3]
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[rows]) / len(rows)
            gh = (g @ weights[2].T) * (h > 0)
            grads = [z[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
            step += 1
            for w, gr, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # The true neighbours of the rows set aside, among the rest of the sample.
    true = _nearest(held, x, min(k, len(x)), own=False)
    home = router.parts(x, 1)[:, 0]
    place = np.argsort(router.parts(held, n_parts), axis=1)  # of each part in a query's order
    place = np.take_along_axis(place, home[true], axis=1)
    reached = [(place < n).mean() for n in range(1, n_parts + 1)]
    if len(held) >= _LEAST_HELD:
        router.probes = next((n for n, r in enumerate(reached, 1) if r >= recall), n_parts)
    return router


def _assign(router: Router, width: int):
    def run(batches):
        for batch in batches:
            x, lengths = matrix(batch.column("v"), width)
            once = np.sort(_once(batch.column("id").to_numpy(), x, lengths, np.arange(len(x))))
            batch, x = batch.take(pa.array(once)), x[once]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(router.parts(x, 1)[:, 0].astype(np.int64))], names=["id", "v", "part"])

    return run


def _route(router: Router, width: int):
    def run(batches):
        for batch in batches:
            x, _ = matrix(batch.column("v"), width)
            parts = router.parts(x, router.probes)
            row = pa.array(np.repeat(np.arange(len(x)), parts.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("v").take(row), pa.array(parts.ravel().astype(np.int64))], names=["id", "v", "part"])

    return run


def _once(ids: np.ndarray, x: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` without those that repeat both id and vector of another one."""
    if len(np.unique(ids[rows])) == len(rows):
        return rows
    seen = {}
    for r in rows.tolist():
        seen.setdefault((ids[r], lengths[r], x[r].tobytes()), r)
    return np.array(list(seen.values()), np.int64)


def _rerank(width: int, k: int):
    """The k nearest candidates of each query in a piece, by exact distance."""

    def run(batches):
        for _, table in runs(batches, ["part", "piece"]):
            side, ids = table["side"].to_numpy(), table["id"].to_numpy()
            x, lengths = matrix(table["v"], width)
            queries, rows = np.flatnonzero(side == 1), _once(ids, x, lengths, np.flatnonzero(side == 0))
            found = []
            if len(rows):
                norm = (x[rows] ** 2).sum(axis=1)
                for i in range(0, len(queries), 256):
                    q = queries[i : i + 256]
                    d = (x[q] ** 2).sum(axis=1)[:, None] + norm - 2 * x[q] @ x[rows].T
                    d[(ids[q][:, None] == ids[rows]) | (lengths[q][:, None] != lengths[rows])] = np.inf
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(q), np.inf)
                    slack = 1e-9 * (1 + (x[q] ** 2).sum(axis=1))
                    for j, one in enumerate(q.tolist()):
                        near = rows[(d[j] <= edge[j] + slack[j]) & np.isfinite(d[j])]
                        exact = np.sqrt(((x[near] - x[one]) ** 2).sum(axis=1))
                        best = np.lexsort((ids[near], exact))[:k]
                        found.append((np.full(len(best), ids[one]), ids[near][best], exact[best]))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows found for each query.

    score is the Euclidean distance in double precision; ties go to the smaller
    id. A row with the query's id is no candidate. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, on either side, nor
    do rows with a null id; vectors of another length than the query's are no
    candidates. Repeated rows count once; of an id's different vectors the
    nearest counts. Empty tables give no rows. The index is fitted on
    ``ROWS_A_PART`` rows for each part, between ``LEAST_FIT`` and ``MOST_FIT``
    and within ``FIT_BYTES``, places every row, and visits as many parts as ``recall`` takes on the rows
    that were set aside.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = width_of((vectors, vector_col), (queries, vector_col))
    rows, asked = usable(vectors, id_col, vector_col, kind), usable(queries, id_col, vector_col, kind)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    wide = asked.agg(F.max(F.size("v")).alias("width")).first().width or 0
    width = max(shape.width or 1, wide)
    n_parts = 2 ** round(math.log2(min(MOST_PARTS, max(LEAST_PARTS, shape.n / PART_ROWS))))
    fitted = min(MOST_FIT, max(LEAST_FIT, ROWS_A_PART * n_parts))
    fitted = max(4, min(fitted, FIT_BYTES // (8 * width)))
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(fitted).select("v").toArrow()
    x, _ = matrix(sample["v"], width)
    router = fit_router(x, n_parts, recall, k)
    rows, asked = (df.repartition(max(2, math.ceil(shape.n / 20_000))) for df in (rows, asked))
    schema = f"id long, v array<{kind}>, part long"
    placed = stored(rows.mapInArrow(lean(_assign(router, width)), schema), "ann-rows")
    routed = asked.mapInArrow(lean(_route(router, width)), schema)
    # One row a part.
    pieces = F.broadcast(placed.groupBy("part").agg(F.ceil(F.count("*") / PIECE).cast("long").alias("pieces")))
    candidates = placed.join(pieces, "part").select("id", "v", "part", F.pmod(F.xxhash64("id", "v"), "pieces").alias("piece"), F.lit(0).alias("side"))
    sent = routed.join(pieces, "part").select("id", "v", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("side"))
    dealt = candidates.unionByName(sent).repartition("part", "piece").sortWithinPartitions("part", "piece")
    found = dealt.mapInArrow(lean(_rerank(width, k)), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""A vector index: inverted lists of coarse centroids with product-quantised codes, re-ranked exactly.

Vectors of length one are assigned to the nearest coarse centroid; what remains
is cut into pieces of a few dimensions, each written as the number of its
nearest codeword. A list is a folder with codes and, apart from them, vectors.
With each code goes the distance between a vector and its quantised form, and
with each list its radius. So a search may either read a few lists, or be
exact: by the triangle inequality a list farther than its radius beyond the
k-th best, and a code farther than its error beyond it, can hold no result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.plans import segments
from strandmap.plans.retrieval import cosine, top
from strandmap.plans.segments import Folder, Segments, Writer
from strandmap.session import ship

#: Vectors that centroids and codewords are fitted on at most, and bytes of them.
MOST_FITTED, MOST_BYTES = 32_768, 64 << 20
#: Lists at the least and at the most, vectors a list, dimensions of a piece, and codewords of one.
LEAST_LISTS, MOST_LISTS, A_LIST, PIECE, WORDS = 8, 4096, 64, 2, 256
#: Hits of an approximate search that are re-ranked exactly, times k.
RERANKED = 10
#: Room for rounding of 32-bit sums in a bound.
_SLACK = 1e-4
#: The list of vectors that no centroid can stand for: those without direction, whose cosine counts as 0.
NOWHERE = -1


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of at most k groups of the rows; a group that loses all rows starts anew at a far one."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    centres = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        d = np.concatenate([_squares(part, centres) for part in np.array_split(x, max(1, len(x) // 4096))])
        near = d.argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, near, x)
        fresh = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        lost = np.flatnonzero(n == 0)
        fresh[lost] = x[np.argsort(-d.min(axis=1), kind="stable")[: len(lost)]]
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centres: a row a list; words: for each piece of dimensions its codewords."""

    centres: np.ndarray
    words: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def pieces(self) -> list[slice]:
        return [slice(i, min(self.width, i + PIECE)) for i in range(0, self.width, PIECE)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: list, code, error of the code, distance from the list's centre."""
        d = _squares(x, self.centres)
        near = d.argmin(axis=1)
        rest = x - self.centres[near]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        left = np.empty_like(rest)
        for i, (part, words) in enumerate(zip(self.pieces(), self.words, strict=True)):
            codes[:, i] = _squares(rest[:, part], words).argmin(axis=1)
            left[:, part] = rest[:, part] - words[codes[:, i]]
        return near, codes, np.sqrt((left**2).sum(axis=1)), np.sqrt((rest**2).sum(axis=1))

    def distances(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of a unit vector from quantised forms, by one table a list and piece."""
        out = np.zeros(len(lists))
        for at in np.unique(lists):
            rows = lists == at
            rest = q - self.centres[at]
            part = codes[rows]
            total = np.zeros(len(part))
            for i, (piece, words) in enumerate(zip(self.pieces(), self.words, strict=True)):
                total += ((rest[piece] - words) ** 2).sum(axis=1)[part[:, i]]
            out[rows] = np.sqrt(total)
        return out

    def packed(self) -> dict[str, bytes | int]:
        return {"width": self.width, "centres": self.centres.astype("<f4").tobytes(), "words": b"".join(w.astype("<f4").tobytes() for w in self.words), "sizes": b"".join(len(w).to_bytes(4, "little") for w in self.words)}

    @staticmethod
    def unpacked(row) -> Quantiser:
        centres = np.frombuffer(row.centres, "<f4").reshape(-1, row.width)
        sizes = np.frombuffer(row.sizes, "<u4").tolist()
        flat, words, at = np.frombuffer(row.words, "<f4"), [], 0
        for i, n in enumerate(sizes):
            wide = min(row.width, (i + 1) * PIECE) - i * PIECE
            words.append(flat[at : at + n * wide].reshape(n, wide))
            at += n * wide
        return Quantiser(centres, words)


def fit(sample: np.ndarray, n_lists: int) -> Quantiser:
    """Centroids of unit vectors, and codewords of what they leave."""
    centres = k_means(sample, n_lists)
    rest = sample - centres[_squares(sample, centres).argmin(axis=1)]
    words = [k_means(rest[:, i : i + PIECE], WORDS, rounds=8) for i in range(0, sample.shape[1], PIECE)]
    return Quantiser(centres, words)


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column of one width as unit vectors, and which have a direction."""
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x**2).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    return (x / np.where(fine, norm, 1)[:, None]).astype(np.float32), fine


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor empty nor has null or non-finite entries."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad)


@dataclass
class VectorIndex:
    """Live codes (list, key, code, error) and vectors (list, key, vector) of an index, by segments."""

    live: Segments
    quantiser: Quantiser

    @property
    def key(self) -> str:
        return self.live.key

    @cached_property
    def lists(self) -> dict[int, tuple[float, int]]:
        """The largest distance from its centre in each list, and its vectors, hidden ones too; a row a list."""
        rows = self.live.read("lists").groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()
        return {r.list: (r.radius, r.n) for r in rows}

    def _scored(self, q: np.ndarray, lists: list[int], among: DataFrame | None) -> DataFrame:
        """(list, key, low, high): bounds of the distance of every code of some lists."""
        codes = self.live.read("codes", lambda rows, _: rows.where(F.col("list").isin(lists)))
        if among is not None:
            codes = codes.join(among, self.key, "left_semi")
        quantiser, key = self.quantiser, self.key
        schema = T.StructType([T.StructField("list", T.IntegerType()), codes.schema[key]]).add("low", "double").add("high", "double")

        def run(batches):
            for batch in batches:
                where = batch.column("list").to_numpy()
                error = batch.column("error").to_numpy()
                d = np.full(len(where), np.sqrt(2.0))  # a cosine of 0
                real = where != NOWHERE
                if real.any():
                    code = np.frombuffer(b"".join(batch.column("code").filter(pa.array(real)).to_pylist()), np.uint8).reshape(int(real.sum()), -1)
                    d[real] = quantiser.distances(q, where[real], code)
                yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column(key), pa.array(np.maximum(d - error - _SLACK, 0)), pa.array(d + error + _SLACK)], names=schema.names)

        return codes.select("list", key, "code", "error").mapInArrow(run, schema)

    def _exact(self, candidates: DataFrame, lists: list[int], vector: list[float], k: int) -> DataFrame:
        """Cosines of the candidates' own vectors, which are read from their lists alone."""
        vectors = self.live.read("vectors", lambda rows, _: rows.where(F.col("list").isin(lists)))
        near = vectors.join(candidates.select("list", self.key), ["list", self.key], "left_semi")
        return top(cosine(near, vector, "vector").select(self.key, "raw_score"), k, self.key)

    def lists_for(self, vector: list[float], probes: int | None = None) -> list[int]:
        """Lists by the distance of their centres from a vector, ``probes`` of them at the most, and the list without direction."""
        q = _direction(vector)
        d = np.sqrt(_squares(q[None], self.quantiser.centres)[0])
        order = [int(i) for i in np.argsort(d, kind="stable") if int(i) in self.lists]
        return order[:probes] + ([NOWHERE] if NOWHERE in self.lists else [])

    def search(self, vector: list[float], k: int, among: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(key, raw_score): the k vectors of the highest cosine, ties by key; vectors of another width are not in the index.

        With ``probes``, so many lists are read and the best codes are re-ranked:
        approximate. Without it the result is exact: the nearest lists give a
        bound, lists beyond it are not read, and codes beyond the k-th upper
        bound are not re-ranked. ``among`` is a frame of keys that may be found.
        """
        q = _direction(vector)
        if len(vector) != self.quantiser.width or not np.any(q):
            rows = self.live.read("vectors")
            rows = rows if among is None else rows.join(among, self.key, "left_semi")
            return top(cosine(rows, vector, "vector").select(self.key, "raw_score"), k, self.key)
        if probes is not None:
            lists = self.lists_for(vector, probes)
            best = self._scored(q, lists, among).orderBy("high", self.key).limit(RERANKED * k)
            return self._exact(F.broadcast(best), lists, vector, k)  # RERANKED times k rows
        order = self.lists_for(vector)
        full = np.cumsum([self.lists[i][1] for i in order])
        bound = self._bound(q, order[: int(np.searchsorted(full, k)) + 1], among, k)
        centres = np.sqrt(_squares(q[None], self.quantiser.centres)[0])
        lists = [i for i in order if i == NOWHERE or centres[i] - self.lists[i][0] - _SLACK <= bound]
        bound = self._bound(q, lists, among, k)
        near = self._scored(q, lists, among).where(F.col("low") <= bound)
        return self._exact(near, lists, vector, k)

    def _bound(self, q: np.ndarray, lists: list[int], among: DataFrame | None, k: int) -> float:
        """The k-th upper bound of the distances in some lists; infinite if they have fewer vectors."""
        highs = self._scored(q, lists, among).select("high").orderBy("high").limit(k)
        row = highs.agg(F.count("*").alias("n"), F.max("high").alias("high")).first()
        return float(row.high) if row.n == k else float("inf")


def _direction(vector: list[float]) -> np.ndarray:
    q = np.array(vector, float)
    norm = np.sqrt((q**2).sum())
    return q / norm if norm > 0 and np.isfinite(norm) else np.zeros(len(q))


def _writer(vectors: DataFrame, key: str, column: str, quantiser: Quantiser) -> Writer:
    width = quantiser.width
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)
    rows = _usable(vectors, column).where(F.size(column) == width).select(key, F.col(column).alias("vector"))
    schema = T.StructType([T.StructField("list", T.IntegerType()), rows.schema[key], rows.schema["vector"]]).add("code", "binary").add("error", "double").add("far", "double")

    def run(batches):
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fine = _unit(batch.column("vector"), width)
            near, codes, error, far = q.encode(x)
            near = np.where(fine, near, NOWHERE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), batch.column(key), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.where(fine, error, 0.0).astype(float)), pa.array(np.where(fine, far, 0.0).astype(float))], names=schema.names)

    def write(folder: Folder) -> dict:
        coded = rows.mapInArrow(run, schema).repartitionByRange(F.col("list"), F.col(key)).sortWithinPartitions("list", key)
        # Codes apart from vectors: a search reads the codes of its lists, and vectors of few rows. Encoding is cheaper than storing both at once.
        codes = folder.put("codes", coded.select("list", key, "code", "error", "far"), by="list")
        folder.put("vectors", coded.select("list", key, "vector"), by="list")
        folder.put("lists", codes.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")))
        return {"rows": codes.count()}

    return write


def build(vectors: DataFrame, path: str, key: str, column: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Write an index of vectors with distinct keys: a row of null, empty, non-finite or another width than most is left out.

    Centroids and codewords are fitted on a sample bounded in rows and bytes,
    those whose keys have the smallest hashes; every vector is indexed.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = _usable(vectors, column)
    sizes = fine.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not sizes:
        raise ValueError("no vector to index")
    width, n = sizes[0]["width"], sizes[0]["count"]
    most = max(1, min(MOST_FITTED, MOST_BYTES // (8 * width)))
    chosen = fine.where(F.size(column) == width).orderBy(F.xxhash64(key), key).limit(most).select(F.col(column).cast("array<double>").alias("v"))
    sample, fine_rows = _unit(chosen.toArrow().column("v").combine_chunks(), width)
    sample = sample[fine_rows] if fine_rows.any() else np.eye(1, width, dtype=np.float32)
    wanted = lists or min(MOST_LISTS, max(LEAST_LISTS, round(n / max(A_LIST, np.sqrt(n)))))
    quantiser = fit(sample, wanted)
    spark.createDataFrame([tuple(quantiser.packed().values())], "width int, centres binary, words binary, sizes binary").coalesce(1).write.parquet(f"{path}/quantiser")
    return VectorIndex(segments.create(spark, path, key, _writer(vectors, key, column, quantiser), column=column), quantiser)


def load(spark: SparkSession, path: str, generation: int | None = None) -> VectorIndex:
    ship(spark)
    return VectorIndex(segments.load(spark, path, generation), Quantiser.unpacked(spark.read.parquet(f"{path}/quantiser").first()))


def update(index: VectorIndex, changed: DataFrame | None = None, removed: DataFrame | None = None) -> VectorIndex:
    """A generation with vectors replaced, added or removed; centroids and codewords stay."""
    now, key = index.live, index.key
    told = [df.select(key) for df in (changed, removed) if df is not None]
    keys = told[0] if len(told) == 1 else told[0].unionByName(told[1])
    hidden = {"rows": now.read("codes").join(keys.distinct(), key, "left_semi").count()}
    write = None if changed is None else _writer(changed, key, now.state["column"], index.quantiser)
    return VectorIndex(segments.change(now, keys, hidden, write), index.quantiser)


def compact(index: VectorIndex) -> VectorIndex:
    """Merge segments that are due."""
    now = index.live

    def rewrite(due: list[dict], folder: Folder) -> dict:
        rows = now.read("vectors", of=due).drop("list")
        return _writer(rows, index.key, "vector", index.quantiser)(folder)

    return VectorIndex(segments.compact(now, rewrite), index.quantiser)

"""A substring index: postings of trigrams lead to the few rows that can hold a needle, which are then verified.

The text of a row is indexed folded, as its distinct runs of three characters.
A needle's own runs are intersected, the rarest ones by a dictionary of their
counts; what is left are candidates by key and block, and rows are stored in
blocks by key, so only blocks with candidates are read. Needles of fewer than
three characters have no runs: they are looked for in all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.functions import text
from strandmap.plans import segments
from strandmap.plans.segments import Folder, Segments, Writer
from strandmap.session import ship

#: Runs of a needle that are intersected at most, and candidates that are broadcast to their rows at most.
MOST_GRAMS, BROADCAST_CANDIDATES = 8, 200_000
#: Key, text and number of rows that a task takes apart at once, in characters.
_SLICE = 2_000_000
_HIDDEN = "_folded"


def grams(folded: str) -> np.ndarray:
    """Distinct runs of three characters as whole numbers of 63 bits, rising."""
    codes = np.frombuffer(folded.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])


@dataclass
class SubstringIndex:
    """rows: block, key and the carried columns; grams: run, key, block, part; terms: run, part, n."""

    live: Segments

    @property
    def key(self) -> str:
        return self.live.key

    @property
    def rows(self) -> DataFrame:
        """All live rows, as they were indexed."""
        return self.live.read("rows").drop("block", _HIDDEN)

    def _rarest(self, wanted: list[int]) -> tuple[list[int], dict[str, list[int]]]:
        """The rarest of the runs, and the parts of the postings that hold them by segment; no run if one of them occurs nowhere."""
        counts, parts = dict.fromkeys(wanted, 0), []
        for segment, terms in self.live.parts_of("terms"):
            for r in terms.where(F.col("run").isin(wanted)).collect():  # a needle's runs
                counts[r.run] += r.n
                parts.append((segment["path"], r.part, r.run))
        if not all(counts.values()):
            return [], {}
        rare = sorted(wanted, key=lambda g: (counts[g], g))[:MOST_GRAMS]
        found: dict[str, set[int]] = {}
        for path, part, run in parts:
            if run in rare:
                found.setdefault(path, set()).add(part)
        return rare, {k: sorted(v) for k, v in found.items()}

    def candidates(self, needles: list[str]) -> list[tuple[dict, DataFrame]] | None:
        """(segment, frame of key and block) of rows that may hold all needles; None if no needle has three characters."""
        runs = [grams(text_fold(n)) for n in needles if len(n) >= 3]
        if not runs:
            return None
        wanted = np.unique(np.concatenate(runs)).tolist()
        rare, parts = self._rarest(wanted)
        out = []
        for segment, postings in self.live.parts_of("grams"):
            if segment["path"] in parts:
                met = postings.where(F.col("part").isin(parts[segment["path"]]) & F.col("run").isin(rare))
                out.append((segment, met.groupBy(self.key, "block").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(self.key, "block")))
        return out

    def likely(self, needles: list[str]) -> DataFrame:
        """Live rows that may hold all needles, folded; blocks without a candidate are not read."""
        found = self.candidates(needles)
        if found is None:
            return self.rows
        some = []
        for segment, keys in found:
            blocks = keys.groupBy("block").agg(F.count("*").alias("n")).collect()  # a row a block
            if not blocks:
                continue
            near = F.broadcast(keys) if sum(r.n for r in blocks) <= BROADCAST_CANDIDATES else keys
            here = sorted(r.block for r in blocks)
            some.append(self.live.read("rows", lambda rows, _, here=here, near=near: rows.where(F.col("block").isin(here)).join(near.select(self.key), self.key, "left_semi"), of=[segment]))
        if not some:
            return self.rows.limit(0)
        return reduce(lambda a, b: a.unionByName(b), some).drop("block", _HIDDEN)

    def containing(self, needles: list[str], test: Column) -> DataFrame:
        """Live rows that pass a test which implies that they hold all needles, folded."""
        return self.likely(needles).where(test)


def text_fold(needle: str) -> str:
    """A needle as texts are folded."""
    return needle.lower().replace("ё", "е")


def _writer(rows: DataFrame, key: str, hay: Column, keep: list[str]) -> Writer:
    spark = rows.sparkSession
    ship(spark)
    kept = rows.select(key, *keep, text.fold(hay).alias(_HIDDEN))
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField(key, kind), T.StructField("block", T.IntegerType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                found = []
                while end < len(texts) and (size < _SLICE or end == start):
                    t = texts[end] or ""
                    found.append(grams(t) if len(t) >= 3 else np.zeros(0, np.int64))
                    size += len(t)
                    end += 1
                owner = pa.array(np.repeat(np.arange(start, end), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(owner), batch.column(1).take(owner)], names=schema.names)
                start = end

    def write(folder: Folder) -> dict:
        dealt = kept.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("block", F.spark_partition_id())
        stored = folder.put("rows", dealt, by="block")
        postings = stored.select(key, "block", _HIDDEN).mapInArrow(run, schema)
        # A common run is parted by its keys; a part is one task's range.
        ranged = postings.repartitionByRange(F.col("run"), F.col(key)).sortWithinPartitions("run", key).withColumn("part", F.spark_partition_id())
        grams_ = folder.put("grams", ranged, by="part")
        folder.put("terms", grams_.groupBy("run", "part").agg(F.count("*").alias("n")).repartitionByRange("run").sortWithinPartitions("run"))
        return {"rows": stored.count()}

    return write


def build(rows: DataFrame, path: str, key: str, hay: Column, keep: list[str]) -> SubstringIndex:
    """Index the text ``hay`` of rows with distinct keys that are not null; columns ``keep`` are stored with them."""
    keep = [c for c in keep if c != key]
    return SubstringIndex(segments.create(rows.sparkSession, path, key, _writer(rows, key, hay, keep), keep=keep))


def update(index: SubstringIndex, hay: Column, changed: DataFrame | None = None, removed: DataFrame | None = None) -> SubstringIndex:
    """A generation with rows replaced, added or removed; ``hay`` as it was built with."""
    now, key = index.live, index.key
    told = [df.select(key) for df in (changed, removed) if df is not None]
    keys = reduce(DataFrame.unionByName, told).distinct()
    hidden = {"rows": now.read("rows").join(keys, key, "left_semi").count()}
    return SubstringIndex(segments.change(now, keys, hidden, None if changed is None else _writer(changed, key, hay, now.state["keep"])))


def compact(index: SubstringIndex) -> SubstringIndex:
    """Merge segments that are due; texts stay folded as they were stored."""
    now = index.live

    def rewrite(due: list[dict], folder: Folder) -> dict:
        return _writer(now.read("rows", of=due), index.key, F.col(_HIDDEN), now.state["keep"])(folder)

    return SubstringIndex(segments.compact(now, rewrite))


def load(spark: SparkSession, path: str, generation: int | None = None) -> SubstringIndex:
    return SubstringIndex(segments.load(spark, path, generation))

"""An index in segments: edits add a segment and tombstones, reads merge, compaction rewrites by size.

A segment is a folder with a Parquet folder for each part of the index; it is
never changed. Tombstones are the keys that a generation removed or replaced:
they hide rows of older segments only. What is live is named by a manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap import manifest

#: Tombstones that are broadcast to a segment at most.
BROADCAST_KEYS = 500_000
#: A segment is merged with newer ones once they have this share of its rows; all are, once this share of all rows is dead.
MERGE_SHARE, DEAD_SHARE = 0.5, 0.2


@dataclass
class Folder:
    """A segment that is being written, with the schemas of its parts: a part without rows has no file to tell its own."""

    path: str
    schemas: dict[str, str] = field(default_factory=dict)

    def put(self, part: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        """Store a part, in folders of ``by`` if told, and give it back as it is stored."""
        (rows.write if by is None else rows.write.partitionBy(by)).parquet(f"{self.path}/{part}")
        self.schemas[part] = rows.schema.json()
        return _stored(rows.sparkSession, self.path, self.schemas, part)


def _stored(spark: SparkSession, path: str, schemas: dict[str, str], part: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(schemas[part]))).parquet(f"{path}/{part}")


#: Stores the parts of a segment and returns whole numbers about it, its number of ``rows`` among them.
Writer = Callable[[Folder], dict]


@dataclass(frozen=True)
class Segments:
    """A generation of an index: ``state`` is its manifest."""

    spark: SparkSession
    root: str
    state: dict

    @property
    def key(self) -> str:
        return self.state["key"]

    @property
    def generation(self) -> int:
        return self.state["generation"]

    def total(self, fact: str) -> int:
        """A fact of the segments summed over live rows."""
        return sum(s[fact] for s in self.state["segments"]) - self.state["hidden"].get(fact, 0)

    def tombstones(self, segment: dict) -> DataFrame | None:
        """Keys that hide rows of a segment; broadcast behind a check of their number."""
        later = [t for t in self.state["tombstones"] if t["generation"] > segment["generation"]]
        if not later:
            return None
        keys = reduce(DataFrame.unionByName, (self._part(t, "keys") for t in later)).distinct()
        return F.broadcast(keys) if sum(t["rows"] for t in later) <= BROADCAST_KEYS else keys

    def read(self, part: str, narrow: Callable[[DataFrame, dict], DataFrame] | None = None, of: list[dict] | None = None) -> DataFrame:
        """Live rows of a part over all segments; ``narrow`` filters a segment before anything else."""
        found = []
        for segment in self.state["segments"] if of is None else of:
            rows = self._part(segment, part)
            rows = narrow(rows, segment) if narrow else rows
            dead = self.tombstones(segment)
            found.append(rows if dead is None or self.key not in rows.columns else rows.join(dead, self.key, "left_anti"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def parts_of(self, part: str) -> list[tuple[dict, DataFrame]]:
        """Each segment with all rows of a part, hidden ones too."""
        return [(s, self._part(s, part)) for s in self.state["segments"]]

    def _part(self, segment: dict, part: str) -> DataFrame:
        return _stored(self.spark, f"{self.root}/{segment['path']}", segment["schemas"], part)

    def due(self) -> list[dict]:
        """Segments to merge: from the newest on while an older one is not much larger than all newer ones; all, if many rows are dead."""
        segments = self.state["segments"]
        rows = sum(s["rows"] for s in segments)
        if self.state["hidden"].get("rows", 0) > DEAD_SHARE * max(rows, 1):
            return list(segments)
        picked, total = [segments[-1]], segments[-1]["rows"]
        for s in reversed(segments[:-1]):
            if total < MERGE_SHARE * s["rows"]:
                break
            picked.insert(0, s)
            total += s["rows"]
        return picked if len(picked) > 1 else []


def load(spark: SparkSession, root: str, generation: int | None = None) -> Segments:
    """The newest generation, or a pinned one."""
    state = manifest.read(spark, root, generation)
    if state is None:
        raise FileNotFoundError(f"{root}: no generation {'at all' if generation is None else generation}")
    return Segments(spark, root, state)


def _write(root: str, kind: str, write: Writer) -> dict:
    path = f"{kind}-{uuid.uuid4().hex}"
    folder = Folder(f"{root}/{path}")
    facts = write(folder)
    return {"path": path, "schemas": folder.schemas} | facts


def _plus(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    return {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}


def create(spark: SparkSession, root: str, key: str, write: Writer, **told) -> Segments:
    """The first generation: ``write`` stores one segment, ``told`` is kept in all manifests."""
    segment = _write(root, "segment", write) | {"generation": 1}
    state = {"key": key, "segments": [segment], "tombstones": [], "hidden": {}, **told}
    return Segments(spark, root, manifest.commit(spark, root, state, 1))


def change(now: Segments, keys: DataFrame, hidden: dict[str, int], write: Writer | None) -> Segments:
    """A generation in which ``keys`` (column key) are hidden in all segments so far, and ``write`` adds one.

    hidden: facts of the live rows that the keys hide. FileExistsError if another writer was faster.
    """
    generation = now.generation + 1

    def put(folder: Folder) -> dict:
        return {"rows": folder.put("keys", keys.select(F.col(now.key)).distinct()).count()}

    stone = _write(now.root, "tombstones", put) | {"generation": generation}
    added = [_write(now.root, "segment", write) | {"generation": generation}] if write else []
    state = now.state | {"segments": now.state["segments"] + added, "tombstones": now.state["tombstones"] + [stone], "hidden": _plus(now.state["hidden"], hidden)}
    return Segments(now.spark, now.root, manifest.commit(now.spark, now.root, state, generation))


def compact(now: Segments, rewrite: Callable[[list[dict], Folder], dict]) -> Segments:
    """A generation in which segments that are due are one, without hidden rows; ``now`` if none is due.

    Files of earlier generations stay, as readers may have pinned them.
    """
    due = now.due()
    if not due:
        return now
    generation = now.generation + 1
    merged = _write(now.root, "segment", lambda folder: rewrite(due, folder)) | {"generation": generation}
    rest = [s for s in now.state["segments"] if s not in due]
    oldest = min((s["generation"] for s in rest), default=generation)
    stones = [t for t in now.state["tombstones"] if t["generation"] > oldest]
    gone = {f: merged[f] - sum(s[f] for s in due) for f in merged if isinstance(merged[f], int) and f != "generation"}
    state = now.state | {"segments": rest + [merged], "tombstones": stones, "hidden": _plus(now.state["hidden"], gone)}
    return Segments(now.spark, now.root, manifest.commit(now.spark, now.root, state, generation))

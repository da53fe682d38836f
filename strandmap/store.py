"""Stored forms of a catalog that many queries read: built on first use, kept in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.manifest import files_stamp
from strandmap.session import shared_dir

_BUILT: dict[tuple[str, str, str], tuple[str, str]] = {}


def once(spark: SparkSession, source: str, name: str, build: Callable[[str], None]) -> str:
    """Folder of a stored form of ``source``, which ``build`` writes once for each application and state of the source.

    The state is told by names, sizes and times of the files below the source:
    when one of them changes, the next call builds anew.
    """
    key = (spark.sparkContext.applicationId, source.rstrip("/"), name)
    state = hashlib.sha256(files_stamp(spark, source).encode()).hexdigest()
    if _BUILT.get(key, ("", ""))[0] != state:
        path = f"{shared_dir(spark)}/strandmap/{name}-{uuid.uuid4().hex}"
        build(path)
        _BUILT[key] = (state, path)
    return _BUILT[key][1]


def write_sorted(frame: DataFrame, path: str, by: str, sort: str, split: str | None = None) -> None:
    """Write partitions of ``by``, dealt and sorted by ranges, so that a large value of ``by`` is many files and scans skip.

    Ranges can't part rows that are equal in all they sort by: ``split`` is a
    further column that tells rows of one crowded ``sort`` value apart.
    """
    order = [by, sort, *([split] if split else [])]
    frame.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).write.partitionBy(by).parquet(path)

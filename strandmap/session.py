"""Where lineage is cut, and how code reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Where PYTHONPATH names the repository, it is importable already; elsewhere
    it goes to the executors as a zip, once for each application.
    """
    app = spark.sparkContext.applicationId
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":") or app in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="strandmap-"), "strandmap_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((_ROOT / "strandmap").rglob("*.py")):
            out.write(path, path.relative_to(_ROOT).as_posix())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, and the session's checkpoint folder.

    Read from ``spark.checkpoint.dir``. Only where that is unset, a local
    session (tests) makes a folder; on a cluster this raises, as a folder of
    the driver's machine is none of the executors'.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="strandmap-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed and kept in the checkpoint folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint()

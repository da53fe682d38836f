"""Session helpers shared by the operators: stored intermediates, shipping code, row batches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap import session

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 * 1024 * 1024
_UNITS = {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Arrow batches are held to ``BATCH_BYTES`` unless the session asks for less,
    so that a worker's memory doesn't depend on the length of texts. The limit
    is a setting of the session and stays, as plans are run later.
    """
    held = spark.conf.get(_BATCH).lower().rstrip("b")
    held = int(held[:-1]) * _UNITS[held[-1]] if held[-1:] in _UNITS else int(held)
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    session.ship(spark)


def _release() -> None:
    """Give memory that is free within this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep their own ways
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A function for mapInArrow that leaves a small worker behind: idle ones count against an executor's memory."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    See ``session.shared_dir``: without ``spark.checkpoint.dir`` a local session
    makes one, and a cluster raises.
    """
    return session.shared_dir(spark)


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/strandmap/{tag}-{uuid.uuid4().hex}"
    if (kept := _SCRATCH.get()) is not None:
        kept.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete at the end what operators store meanwhile; results have to be written before."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            drop(spark, path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    The files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int) -> DataFrame:
    """Deal rows over at least ``least`` tasks when a small input has fewer splits."""
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def text_slices(lengths, most: int):
    """Row ranges whose lengths sum to ``most`` at the most; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a frame has ``rows`` rows at the most; reads no more than that and one."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a check of the number of rows."""
    return F.broadcast(df) if fits(df, rows) else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of one key that a join by shuffle may bring together, and crowded keys that are broadcast at most.
CROWD, MOST_CROWDS = 1024, 500_000


def meet(rows: DataFrame, found: DataFrame, key: list[str], count: str, most: int = MOST_CROWDS) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has one row a key and in ``count`` the number of rows that have it.

    Keys of more than ``CROWD`` rows are broadcast, so a crowd stays where it is
    instead of meeting in one task. Of n rows no more than n / CROWD keys can be
    crowded; where that passes ``most``, the bound on a crowd rises to n / most.
    """
    sums = found.agg(F.sum(count).alias("n"), F.max(count).alias("top")).first()
    crowd = max(CROWD, (sums.n or 0) // most)
    if (sums.top or 0) <= crowd:
        return rows.join(found, key)
    hot, cold = found.where(F.col(count) > crowd), found.where(F.col(count) <= crowd)
    apart = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(apart)


def smallest_hashes(df: DataFrame, n: int, key: str, text: str, more: dict | None = None) -> DataFrame:
    """text (null as empty) and ``more`` of about ``n`` rows: those whose keys have the n smallest hashes.

    Only keys are sorted; the chosen ones, n at the most, are broadcast.
    """
    keys = df.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_h")).orderBy("_h", "_key").limit(n)
    chosen = F.broadcast(keys.select("_key").distinct())
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *((c.alias(k) for k, c in (more or {}).items())))
    return rows.join(chosen, "_key", "left_semi").drop("_key")

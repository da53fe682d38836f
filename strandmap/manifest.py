"""Generations of stored data: a manifest for each, made visible by one rename.

A writer stores new files under names of their own and then commits a manifest
that names them. Readers take the newest manifest, or pin one, so a writer that
dies before its commit leaves the last generation as it was, and two writers
can't both commit the same one. The rename has to be atomic and must not
replace a file, as on HDFS and local file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_FOLDER = "_manifests"


def file_system(spark: SparkSession, path: str):
    """The path as Hadoop knows it, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, root: str) -> list[int]:
    """Committed generations, rising."""
    where, fs = file_system(spark, f"{root}/{_FOLDER}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str, generation: int | None = None) -> dict | None:
    """A generation's manifest, the newest unless one is asked for; None if there is none. Its number is under ``generation``."""
    found = generations(spark, root)
    if not found or (generation is not None and generation not in found):
        return None
    told = found[-1] if generation is None else generation
    text = spark.read.option("wholetext", True).text(f"{root}/{_FOLDER}/{told}.json").first()[0]
    return json.loads(text) | {"generation": told}


def commit(spark: SparkSession, root: str, content: dict, generation: int) -> dict:
    """Make ``content`` the manifest of ``generation``; FileExistsError if another writer has been faster."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fs = file_system(spark, f"{root}/{_FOLDER}/{generation}.json")
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/{_FOLDER}/.{generation}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({k: v for k, v in content.items() if k != "generation"}).encode()))
    finally:
        out.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        if fs.exists(target):
            raise FileExistsError(f"{root}: generation {generation} is committed")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, no_options)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise FileExistsError(f"{root}: generation {generation} is committed") from error
        raise
    return content | {"generation": generation}


def files_stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of all files below a path as one text; empty if there is no such path."""
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return ""
    found = []
    files = fs.listFiles(where, True)
    while files.hasNext():
        s = files.next()
        found.append(f"{s.getPath().toUri().getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return "\n".join(sorted(found))

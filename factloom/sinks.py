"""Versioned builds, upserts and the session log.

A build is a folder of tables written beside the current one.  A small pointer file names the
build that readers see.  Pointers are numbered and never overwritten: a new one appears by one
rename, readers take the highest, and the last KEEP stay for readers under way; so there is no
moment without one, and a crash leaves the old build or the new one.  Authored tables are
numbered folders that are read and replaced in the same way.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from factloom import schema as S
from factloom.operators import knowledge

POINTER = "_CURRENT"
KEEP = 3


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names ``<prefix><number>`` in a folder, from the lowest number to the highest."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()), key=lambda n: int(n[len(prefix) :]))


def _publish(spark: SparkSession, folder: str, prefix: str, beside: str) -> None:
    """Give what was written at *beside* the next number, and drop all but the last KEEP."""
    names = _numbered(spark, folder, prefix)
    number = int(names[-1][len(prefix) :]) + 1 if names else 1
    source, fs = _fs(spark, beside)
    target, _ = _fs(spark, f"{folder}/{prefix}{number:012d}")
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"{target} could not be written")
    for old in names[: -(KEEP - 1)]:
        fs.delete(_fs(spark, f"{folder}/{old}")[0], True)


def _point(spark: SparkSession, root: str, text: str) -> None:
    beside, fs = _fs(spark, f"{root}/_writing-{uuid.uuid4().hex[:8]}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _publish(spark, root, f"{POINTER}.", beside.toString())


def pointer(spark: SparkSession, root: str) -> str:
    """Path of the pointer that counts; without a numbered one, of the plain one that older bases have."""
    names = _numbered(spark, root, f"{POINTER}.")
    return f"{root}/{names[-1] if names else POINTER}"


class BuildLock:
    """At most one build at a time: a file made only if absent; one older than *stale* seconds is taken over."""

    def __init__(self, spark: SparkSession, root: str, stale: float = 6 * 3600) -> None:
        self.spark, self.path, self.stale = spark, f"{root}/_BUILDING", stale

    def __enter__(self) -> BuildLock:
        p, fs = _fs(self.spark, self.path)
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.stale:
            fs.delete(p, False)
        if not fs.createNewFile(p):
            raise RuntimeError("another build is running")
        return self

    def __exit__(self, *_: object) -> None:
        p, fs = _fs(self.spark, self.path)
        fs.delete(p, False)


def write_build(spark: SparkSession, root: str, tables: dict[str, DataFrame], sort: dict[str, list[str]] | None = None) -> str:
    """Write *tables* as a new build and make it current; edges are partitioned by kind, others sorted as asked."""
    _fs(spark, root)[1].mkdirs(_fs(spark, root)[0])
    with BuildLock(spark, root):
        build = f"v={int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"
        for name, df in tables.items():
            keys = (sort or {}).get(name)
            df = df.sortWithinPartitions(*keys) if keys else df
            writer = df.write.partitionBy("kind") if name == "edges" else df.write
            writer.parquet(f"{root}/{build}/{name}")
        _point(spark, root, json.dumps({"build": build, "schema": S.SCHEMA_VERSION}))
    return build


class Degraded(Exception):
    """The fact base is missing, unreadable or of another version."""


def open_build(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current build."""
    try:
        said = json.loads(_read(spark, pointer(spark, root)) or "null")
    except ValueError as e:
        raise Degraded("the pointer of the fact base can't be read") from e
    if not said:
        raise Degraded("there is no fact base; build one first")
    if said["schema"] != S.SCHEMA_VERSION:
        raise Degraded(f"the fact base has schema {said['schema']}, this engine reads {S.SCHEMA_VERSION}; build it again")
    p, fs = _fs(spark, f"{root}/{said['build']}")
    names = [PurePosixPath(s.getPath().toString()).name for s in fs.listStatus(p)]
    return {n: spark.read.parquet(f"{root}/{said['build']}/{n}") for n in names}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The newest version of an authored table, None if there is none."""
    names = _numbered(spark, path, "n=")
    if not names:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{names[-1]}")


def replace_table(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame]) -> None:
    """Write what *make* returns for the present version (or None) as the next one; one writer at a time."""
    _fs(spark, path)[1].mkdirs(_fs(spark, path)[0])
    with BuildLock(spark, path):
        beside = f"{path}/_writing-{uuid.uuid4().hex[:8]}"
        make(read_table(spark, path)).write.parquet(beside)
        _publish(spark, path, "n=", beside)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: list[str], version: str) -> None:
    """Merge rows into an authored table by key."""
    replace_table(spark, path, lambda old: new if old is None else knowledge.upsert(old, new, key, version))


def log_session(spark: SparkSession, path: str, command: str, exit_code: int, rows: int, seconds: float) -> None:
    """One JSON line for a command."""
    spark.createDataFrame([(command, exit_code, rows, seconds)], "command string, exit int, rows bigint, seconds double").write.mode("append").json(path)

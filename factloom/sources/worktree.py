"""What has changed since a build: the commit that is checked out, and the files that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import sinks
from factloom.operators import knowledge
from factloom.sources import code


def head_commit(spark: SparkSession, root: str) -> str | None:
    """The commit that is checked out under *root*, read from its ``.git`` folder; None if there is none."""
    head = (sinks._read(spark, f"{root}/.git/HEAD") or "").strip()
    if not head.startswith("ref: "):
        return head or None
    name = head[5:].strip()
    loose = sinks._read(spark, f"{root}/.git/{name}")
    if loose:
        return loose.strip()
    packed = (sinks._read(spark, f"{root}/.git/packed-refs") or "").splitlines()
    return next((x.split()[0] for x in packed if x.endswith(f" {name}") and not x.startswith("#")), None)


def changes(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, state) of indexed files that were modified or removed since, by content; an edit that was undone is none."""
    known = files.where("content_hash is not null").select("path", "content_hash")
    now = code.tree(spark, root).select("path", "content_hash").join(known.select("path"), "path", "left_semi")
    return knowledge.snapshot_diff(known, now)


def dirty(spark: SparkSession, root: str, files: DataFrame, most: int = 10_000) -> set[str]:
    """Paths of *changes*, to mark answers with; more than *most* call for a new build and are an error."""
    found = [r["path"] for r in changes(spark, root, files).select("path").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} files have changed: build the fact base again")
    return set(found)


def indexable(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files under *root* that an indexer could read."""
    return code.tree(spark, root).select("path").where(F.col("path").rlike(r"\.(?:py|pyi|go|ts|tsx|js|jsx)$"))

"""Shared plumbing: the shared folder for stage tables, text batches, connected components."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as words at a time.
SUB_BATCH_BYTES = 1 << 20
#: Rows of (id, key) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Keys with more rows than this, and than all rows over HOT_KEYS, are joined by broadcast.
HOT_ROWS, HOT_KEYS = 64, 100_000

_RUN = uuid.uuid4().hex[:12]
_ROOTS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for stage tables: a subfolder of ``spark.checkpoint.dir``.

    Where the setting is absent (tests on a local master) a temporary folder is made and
    becomes the checkpoint folder; on any other master its absence is an error, because a
    machine-local folder would not be seen by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/stages-{_RUN}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
    return root


def release(spark: SparkSession) -> None:
    """Delete every stage table written so far; results that still read them become unreadable."""
    for root in [r for r, s in _ROOTS.items() if s is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _ROOTS[root]


@atexit.register
def _clean() -> None:
    for spark in set(_ROOTS.values()):
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is then the cluster's to expire
            pass


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write *df* as Parquet in the shared folder and return the table: lineage ends there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, n: int) -> F.Column:
    """crc32 of the value as text, modulo *n*; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_key() -> F.Column:
    """A hash of the text; with the doc_id it tells rows apart where ids are absent or repeated."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The *names*, each with as many underscores added as make it differ from every column of *df*."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def without(spark: SparkSession, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """*docs* but for the rows whose doc_id and text key are in *rows* (doc_id, text_key).

    *rows* is written, counted, and broadcast if it has BROADCAST_ROWS rows at most.  Null ids
    are equal to each other, so a row without a doc_id is known by its text.
    """
    a, b = fresh(docs, "gone_id", "gone_key")
    gone = staged(spark, rows.select(F.col("doc_id").cast("long").alias(a), F.col("text_key").alias(b)).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (text_key() == F.col(b))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")


def split_join(rows: DataFrame, table: DataFrame, key: str, hot: F.Column, left: bool = False) -> DataFrame:
    """*rows* joined with *table* on *key*, which is unique in *table*; with *left* rows that meet nothing stay.

    Rows of the *hot* keys never meet in one task: the caller sees to it that so few keys are hot
    (each holds more rows than a known share of the total) that they may be broadcast.
    """
    few = F.broadcast(table.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(table.where(~hot), key, "left" if left else "inner")
    return rows.join(few, key).unionByName(rest)


def hot_from(total: int) -> int:
    """Rows from which a key counts as hot, so that of *total* rows at most HOT_KEYS keys are."""
    return max(HOT_ROWS, math.ceil(total / HOT_KEYS))


def docs_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns in *more*; whatever else *df* has is dropped."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sub_batches(texts: list[bytes], limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about *limit* bytes; one long text makes a range by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Memo(dict):
    """A dictionary that computes missing values and forgets all beyond *limit* entries."""

    def __init__(self, make: Callable, limit: int = 200_000) -> None:
        self.make, self.limit = make, limit

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, .. start+len-1 of every range, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)


def merge_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union of the pairs (x, y) in the forest *root*, whose entries point at smallest members."""
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return root
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(up := root[root], root):
            root = up


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each end of an edge (src, dst) can reach.

    Alternating large-star and small-star contraction.  Each round is two groupings with
    map-side minima, whose minima are joined back; it is written to the shared folder, and the
    last round is the one that leaves the edges as they were.  The minima of hubs are broadcast
    (``split_join``), so the edges of a hub stay where they are.
    """

    def star(e: DataFrame, count: int, name: str, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both if large else both.where("dst < src")
        low = near.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("held")).select("src", F.least("src", "low").alias("low"), "held")
        low = staged(spark, low, "minima")
        joined = split_join(near, low, "src", F.col("held") > hot_from(2 * count))
        if large:
            out = joined.where("dst > src").select(F.col("dst").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("dst").alias("a"), F.col("low").alias("b")).unionAll(low.select("src", "low"))
        return staged(spark, out.where("a != b").distinct().select(F.col("b").alias("src"), F.col("a").alias("dst")), name)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src != dst").distinct()
    edges = staged(spark, edges, "edges")
    last = mark(edges)
    for _ in range(rounds):
        if not last[0]:
            break
        edges = star(star(edges, last[0], "large", True), last[0], "small", False)
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))

"""Walks over the edges, all roots at once: one join per level instead of one lookup per node.

Frontiers are written between levels; a node already seen under its root is dropped by an anti
join.  Nothing is collected: loops end when a level is empty, which is one small check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schema as S
from factloom.stage import BROADCAST_ROWS, folder, staged


def neighbours(edges: DataFrame, symbols: DataFrame, files: DataFrame, kind: int = S.CALLS, outward: bool = False, exclude_tests: bool = False, fanout: int | None = None, paths: bool = True) -> DataFrame:
    """(parent, other, source, confidence, path, line, rank, total) for every symbol with neighbours.

    A neighbour's site is its last one.  Outward calls leave out parameters and locals,
    undefined symbols and generated code.  *total* counts all neighbours, *fanout* cuts the rest.
    Sites get their paths last, where *paths* are asked for; those without a file are dealt to all tasks.
    """
    near, far = ("src", "dst") if outward else ("dst", "src")
    other = symbols.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("def_file_id").alias("other_file"))
    if exclude_tests or outward and kind == S.CALLS:  # the files of symbols, before edges are met
        other = other.join(files.select(F.col("id").alias("other_file"), "is_test", "generated"), "other_file", "left")
    if exclude_tests:
        other = other.where(~F.coalesce("is_test", F.lit(False)))
    if outward and kind == S.CALLS:
        other = other.where(~F.col("other_kind").isin(S.TYPE_PARAMETER, S.PARAMETER, S.META, S.LOCAL) & F.col("other_file").isNotNull() & ~F.coalesce("generated", F.lit(False)))
    rows = edges.where(F.col("kind") == kind).select(F.col(near).alias("parent"), F.col(far).alias("other"), "source", "confidence", "file_id", "line")
    rows = rows.join(other.select("other"), "other")
    best = F.max(F.struct("line", (-F.col("source")).alias("low"), "confidence", "file_id"))
    one = rows.groupBy("parent", "other").agg(best.alias("b"))
    one = one.select("parent", "other", (-F.col("b.low")).alias("source"), F.col("b.confidence").alias("confidence"), F.col("b.file_id").alias("file_id"), F.col("b.line").alias("line"))
    order = W.partitionBy("parent").orderBy("source", F.desc("confidence"), "other")
    one = one.withColumns({"rank": F.row_number().over(order), "total": F.count("*").over(W.partitionBy("parent"))})
    one = one if fanout is None else one.where(F.col("rank") <= fanout)
    if not paths:
        return one.select("parent", "other", "source", "confidence", "line", "rank", "total")
    one = one.withColumn("spread", F.when(F.col("file_id").isNull(), F.xxhash64("parent", "other")).otherwise(0))
    one = one.join(files.select(F.col("id").alias("file_id"), "path", F.lit(0).cast("bigint").alias("spread")), ["file_id", "spread"], "left")
    return one.select("parent", "other", "source", "confidence", "path", "line", "rank", "total")


def walk(roots: DataFrame, near: DataFrame, depth: int) -> DataFrame:
    """Nodes (root, node, depth, parent, pos) of a breadth-first walk from every row of *roots* (root) over *near* (parent, other, rank).

    A node belongs to the first parent that lists it, in the order of the level before and of
    each parent's list; *pos* numbers the nodes of a level.
    """
    near = staged(near.select("parent", "other", "rank"), "near")
    level = staged(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(1).alias("pos")), "level")
    seen = level
    for d in range(1, depth + 1):
        came = level.select("root", F.col("node").alias("parent"), F.col("pos").alias("before")).join(near, "parent")
        came = came.groupBy("root", F.col("other").alias("node")).agg(F.min(F.struct("before", "rank", "parent")).alias("by"))
        came = came.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        pos = F.row_number().over(W.partitionBy("root").orderBy("by.before", "by.rank"))
        level = staged(came.select("root", "node", F.lit(d).alias("depth"), F.col("by.parent").alias("parent"), pos.alias("pos")), "level")
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    return seen


def walk_counts(nodes: DataFrame, near: DataFrame, depth: int) -> DataFrame:
    """(root, nodes, revisited, truncated): children met again, and neighbours that a walk left out, of all expanded nodes."""
    expanded = nodes.where(F.col("depth") < depth).select("root", F.col("node").alias("parent"))
    sizes = near.groupBy("parent").agg(F.count("*").alias("listed"), F.max("total").alias("total"))
    sums = expanded.join(sizes, "parent").groupBy("root").agg(F.sum("listed").alias("listed"), F.sum("total").alias("total"))
    counts = nodes.groupBy("root").agg(F.count("*").alias("nodes"))
    out = counts.join(sums, "root", "left").na.fill(0, ["listed", "total"])
    return out.select("root", "nodes", (F.col("listed") - F.col("nodes") + 1).alias("revisited"), (F.col("total") - F.col("nodes") + 1).alias("truncated"))


def distances(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): fewest hops over *edges* (src, dst) from the seeds (root, node), up to *depth*.

    Levels are folders of one table, so all nodes seen are one scan however deep the walk is.  A small
    level is sent to the edges and to the nodes seen, so that a deep walk does not shuffle both a level.
    """
    spark = seeds.sparkSession
    edges = staged(edges.select("src", "dst").distinct(), "hops")
    where = f"{folder(spark)}/reach-{uuid.uuid4().hex[:8]}"
    level = seeds.select("root", "node").distinct()
    schema = level.schema
    for d in range(depth + 1):
        if d:
            small = size <= BROADCAST_ROWS
            front = F.broadcast(level) if small else level
            came = front.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
            seen = spark.read.schema(schema).parquet(where)
            if small:
                came = staged(came, "came")
                few = came.count() <= BROADCAST_ROWS
                met = seen.join(F.broadcast(came), ["root", "node"], "left_semi") if few else seen
                level = came.join(F.broadcast(met) if few else met, ["root", "node"], "left_anti")
            else:
                level = came.join(seen, ["root", "node"], "left_anti")
        level.write.parquet(f"{where}/depth={d}")
        level = spark.read.schema(schema).parquet(f"{where}/depth={d}")
        size = level.count()
        if not size:
            break
    kinds = T.StructType([*schema.fields, T.StructField("depth", T.IntegerType())])
    return spark.read.schema(kinds).parquet(where)


def call_path(edges: DataFrame, source: int, target: int, depth: int = 8) -> DataFrame | None:
    """Hops (step, node) of a shortest path, the smallest parent at each step; None if there is none within *depth*."""
    spark = edges.sparkSession
    edges = staged(edges.where(F.col("kind") == S.CALLS).select("src", "dst").distinct(), "hops")
    level = spark.createDataFrame([(source, None)], "node bigint, parent bigint")
    levels = [level]
    for _ in range(depth):
        if not levels[-1].where(F.col("node") == target).isEmpty():
            break
        came = levels[-1].join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "node")
        for before in levels:
            came = came.join(before.select("node"), "node", "left_anti")
        levels.append(staged(came.select("node", "parent"), "path"))
    at, steps = target, []
    for n in range(len(levels) - 1, -1, -1):  # one row of each level
        row = levels[n].where(F.col("node") == at).first()
        if row is None:
            return None
        steps.append((n, at))
        at = row["parent"]
    return spark.createDataFrame(steps[::-1], "step int, node bigint")


def tests_reaching(roots: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, depth: int) -> DataFrame:
    """(root, test_id, depth): test symbols that call a root directly or through production code."""
    tests = symbols.join(files.where("is_test").select(F.col("id").alias("def_file_id")), "def_file_id").select(F.col("id").alias("test_id"))
    calls = edges.where(F.col("kind") == S.CALLS).select("src", "dst").distinct()
    through = calls.join(tests, F.col("src") == F.col("test_id"), "left_anti")
    inner = distances(roots.select("root", F.col("root").alias("node")), through.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth - 1)
    last = calls.join(tests, F.col("src") == F.col("test_id")).select(F.col("dst").alias("node"), "test_id")
    met = inner.join(last, "node").where("test_id <> root")
    return met.groupBy("root", "test_id").agg((F.min("depth") + 1).alias("depth"))

"""Deployed entrypoints and the code they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.edges import enclosing_type, inside, ranked, spans
from factloom.operators.graph import distances
from factloom.stage import small

REACH_DEPTH = 12
FILE_SYMBOLS = 40


def entry_points(services: DataFrame, on_demand: DataFrame) -> DataFrame:
    """(service, entry_file, command, schedule) of start commands and scheduled runs."""
    start = services.select(F.col("name").alias("service"), "entry_file", "command", F.lit(None).cast("string").alias("schedule"))
    label = F.concat(F.col("service"), F.lit(" ("), F.coalesce("schedule", F.lit("on demand")), F.lit(")"))
    return start.unionByName(on_demand.select(label.alias("service"), "entry_file", "command", "schedule"))


def blind(services: DataFrame, on_demand: DataFrame) -> DataFrame:
    """Names of services that have neither a resolved start command nor a resolved scheduled run."""
    runs = on_demand.where("entry_file is not null").select(F.col("service").alias("name")).distinct()
    return services.where("entry_file is null").select("name").distinct().join(runs, "name", "left_anti")


def entry_file(hints: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file_id): for each (key, hint), the file at that path, else the shortest path that starts with it.

    A path starts with a hint if its first characters, as many as the hint has, are the hint: an
    equality for each length that occurs among the hints, of which a path's length bounds the
    number, and no comparison of every path with every hint.
    """
    hints = hints.select("key", "hint", F.length("hint").alias("size"))
    sizes = sorted(r["size"] for r in hints.where("size is not null").select("size").distinct().collect())
    names = files.select(F.col("id").alias("file_id"), "path")
    cut = names.withColumn("size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))).where(F.length("path") >= F.col("size"))
    joined = cut.withColumn("hint", F.substring("path", F.lit(1), F.col("size"))).join(hints, ["hint", "size"])
    best = F.min(F.struct((F.col("path") != F.col("hint")).alias("far"), F.length("path").alias("n"), "path", "file_id"))
    return joined.groupBy("key").agg(best.alias("b")).select("key", F.col("b.file_id").alias("file_id"))


def mentioning(services: DataFrame, needle: str) -> DataFrame:
    """Names of services whose command or ports hold *needle* in any case."""
    q = needle.lower()
    return services.where(F.lower("command").contains(q) | F.lower(F.array_join("ports", ",")).contains(q)).select("name")


def seeds(entries: DataFrame, symbols: DataFrame, occ: DataFrame) -> DataFrame:
    """(service, node): symbols of an entry file, and those that it refers to outside all bodies."""
    own = entries.where("entry_file is not null").select("service", F.col("entry_file").alias("file_id")).distinct()
    defined = own.join(symbols.select(F.col("def_file_id").alias("file_id"), F.col("id").alias("node")), "file_id").select("service", "node")
    at = small(own.select("file_id").distinct())  # before occurrences are dealt
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).select("file_id", "line", "symbol_id").join(at, "file_id", "left_semi").distinct()
    held = inside(refs.select("file_id", "line").distinct(), spans(symbols)).select("p.file_id", "p.line").distinct()
    free = refs.join(held, ["file_id", "line"], "left_anti").join(own, "file_id").select("service", F.col("symbol_id").alias("node"))
    return defined.unionAll(free).distinct()


def reach(start: DataFrame, edges: DataFrame, depth: int = REACH_DEPTH) -> DataFrame:
    """(service, symbol_id): all that the seeds reach over call and member edges, every service at once."""
    far = distances(start.select(F.col("service").alias("root"), "node"), edges.where("kind in (0, 4)"), depth)
    return far.select(F.col("root").alias("service"), F.col("node").alias("symbol_id"))


def runs(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, service, via): services that run each symbol: itself, else its type, else a symbol of its file.

    The file counts by its FILE_SYMBOLS most referenced symbols; the first of those that is
    reached decides.
    """
    direct = reached.select(F.col("symbol_id").alias("id"), "service").distinct()
    left = symbols.select("id", "def_file_id", "ref_count").join(direct.select("id").distinct(), "id", "left_anti")
    by_type = enclosing_type(symbols).join(left.select("id"), "id", "left_semi").join(direct.withColumnRenamed("id", "type_id"), "type_id").select("id", "service").distinct()
    rest = left.join(by_type.select("id").distinct(), "id", "left_anti").where("def_file_id is not null")
    top = ranked(symbols.where("def_file_id is not null").select("def_file_id", "id", "ref_count"), ["def_file_id"], [F.desc("ref_count"), F.asc("id")]).where(F.col("rank") <= FILE_SYMBOLS)
    hit = top.join(direct.select("id").distinct(), "id", "left_semi").groupBy("def_file_id").agg(F.min(F.struct("rank", "id")).alias("h")).select("def_file_id", F.col("h.id").alias("hit"))
    by_file = rest.join(hit, "def_file_id").join(direct.withColumnRenamed("id", "hit"), "hit").select("id", "service").distinct()
    parts = [direct.join(symbols.select("id"), "id", "left_semi").withColumn("via", F.lit("direct")), by_type.withColumn("via", F.lit("type")), by_file.withColumn("via", F.lit("file"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])

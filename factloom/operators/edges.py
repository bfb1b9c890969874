"""Deriving the relations: definitions, reference counts, call, binder, member and embed edges.

Interval joins carry the file as an equality and, so that one very large file does not make
one task, the block of lines as a second one: a span is listed in each block it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.stage import small, staged

LINES = 256


def dedupe_occurrences(occ: DataFrame) -> DataFrame:
    """One row for each (symbol, file, line, column, role): one that ends its enclosing range if any does."""
    return occ.groupBy("symbol_id", "file_id", "line", "col_start", "role").agg(F.min("enc_end").alias("enc_end"))


def definition_pick(occ: DataFrame, files: DataFrame) -> DataFrame:
    """The definition of each symbol: hand-written before generated, then the first place."""
    own = occ.where(F.col("role").bitwiseAND(1) == 1).join(small(files.select(F.col("id").alias("file_id"), "generated")), "file_id")
    first = F.min(F.struct("generated", "file_id", "line", "col_start", F.coalesce("enc_end", F.lit((1 << 62))).alias("enc")))
    rows = own.groupBy("symbol_id").agg(first.alias("d"))
    end = F.when(F.col("d.enc") < (1 << 62), F.col("d.enc"))
    return rows.select("symbol_id", F.col("d.file_id").alias("def_file_id"), F.col("d.line").alias("def_line"), F.col("d.col_start").alias("def_col_start"), F.col("d.generated").alias("def_generated"), end.alias("def_end_line"))


def ref_counts(occ: DataFrame) -> DataFrame:
    return occ.where(F.col("role").bitwiseAND(1) == 0).groupBy("symbol_id").agg(F.count("*").alias("ref_count"))


def finalize(symbols: DataFrame, occ: DataFrame, files: DataFrame) -> DataFrame:
    """*symbols* (id, ..) with reference counts and picked definitions."""
    picked = definition_pick(occ, files).withColumnRenamed("symbol_id", "id")
    counts = ref_counts(occ).withColumnRenamed("symbol_id", "id")
    out = symbols.join(counts, "id", "left").join(picked, "id", "left")
    return out.withColumns({"ref_count": F.coalesce("ref_count", F.lit(0)), "def_generated": F.coalesce("def_generated", F.lit(False))})


def spans(symbols: DataFrame, *more: str) -> DataFrame:
    """Bodies as (encl, file_id, start, end, block, ..): a row for each block of lines that a body touches."""
    own = symbols.where("def_end_line is not null and def_file_id is not null and def_end_line >= def_line")
    blocks = F.explode(F.sequence(F.floor(F.col("def_line") / LINES), F.floor(F.col("def_end_line") / LINES)))
    return own.select(F.col("id").alias("encl"), F.col("def_file_id").alias("file_id"), F.col("def_line").alias("start"), F.col("def_end_line").alias("end"), blocks.alias("block"), *more)


def inside(points: DataFrame, bodies: DataFrame, how: str = "inner") -> DataFrame:
    """*points* (file_id, line, ..) with the bodies that hold them."""
    points = points.withColumn("block", F.floor(F.col("line") / LINES)).alias("p")
    on = (F.col("p.file_id") == F.col("b.file_id")) & (F.col("p.block") == F.col("b.block")) & (F.col("p.line") >= F.col("b.start")) & (F.col("p.line") <= F.col("b.end"))
    return points.join(bodies.alias("b"), on, how)


def call_edges(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, file_id, line): the innermost body around each reference that is no definition or import."""
    refs = occ.where(F.col("role").bitwiseAND(3) == 0).select("file_id", "line", "col_start", "symbol_id")
    held = inside(refs, spans(symbols)).where("symbol_id <> encl")
    inner = F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "encl"))
    one = held.groupBy("p.file_id", "p.line", "col_start", "symbol_id").agg(inner.alias("i"))
    return one.select(F.col("i.encl").alias("src"), F.col("symbol_id").alias("dst"), "file_id", "line")


def binder_edges(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, file_id, line): references outside all bodies go to the symbol defined on their line."""
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).select("file_id", "line", "col_start", "symbol_id")  # repeats fold at the end
    at = symbols.select(F.col("id").alias("binder"), F.col("def_file_id").alias("file_id"), F.col("def_line").alias("line"), "def_col_start")
    bound = refs.join(at, ["file_id", "line"]).where("binder <> symbol_id")
    held = inside(bound.select("file_id", "line", "symbol_id").distinct(), spans(symbols)).where("symbol_id <> encl").select("p.file_id", "p.line", "symbol_id").distinct()
    free = bound.join(held, ["file_id", "line", "symbol_id"], "left_anti")
    one = free.groupBy("file_id", "line", "col_start", "symbol_id").agg(F.min(F.struct("def_col_start", "binder")).alias("b"))
    return one.select(F.col("b.binder").alias("src"), F.col("symbol_id").alias("dst"), "file_id", "line")


def members(symbols: DataFrame) -> DataFrame:
    """(type_id, member_id): symbols whose container is a type of the same file."""
    types = symbols.where(F.col("kind") == S.TYPE).select(F.col("id").alias("type_id"), F.col("def_file_id").alias("file_id"), F.col("name").alias("container_leaf"))
    own = symbols.select(F.col("id").alias("member_id"), F.col("def_file_id").alias("file_id"), "container_leaf", "def_line")
    return own.join(types, ["file_id", "container_leaf"]).where("member_id <> type_id").select("type_id", "member_id", "file_id", F.col("def_line").alias("line"))


def member_edges(symbols: DataFrame) -> DataFrame:
    return members(symbols).select(F.col("type_id").alias("src"), F.col("member_id").alias("dst"), "file_id", "line")


def all_edges(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call, binder and member edges in the schema that walks use."""
    parts = [(call_edges(occ, symbols), S.CALLS), (binder_edges(occ, symbols), S.CALLS), (member_edges(symbols), S.MEMBER)]
    frames = [e.select("src", "dst", F.lit(k).alias("kind"), F.lit(S.EXACT).alias("source"), F.lit(1.0).alias("confidence"), "file_id", "line") for e, k in parts]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


def enclosing_type(symbols: DataFrame) -> DataFrame:
    """(id, type_id): the narrowest type around a symbol, else the type of its file that its container names."""
    types = symbols.where((F.col("kind") == S.TYPE) & F.col("def_end_line").isNotNull())
    point = symbols.where("def_file_id is not null").select(F.col("id"), F.col("def_file_id").alias("file_id"), F.col("def_line").alias("line"), F.coalesce("def_end_line", "def_line").alias("last"))
    near = inside(point, spans(types)).where("encl <> id and end >= last")
    around = near.groupBy("id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "encl")).alias("t")).select("id", F.col("t.encl").alias("type_id"))
    named = members(symbols).groupBy(F.col("member_id").alias("id")).agg(F.min("type_id").alias("type_id"))
    return around.unionAll(named.join(around.select("id"), "id", "left_anti"))


def handles(hashes: DataFrame, longest: int = 12) -> DataFrame:
    """(symbol_id, handle) from (symbol_id, code): the shortest free prefix of two characters or more, in id order.

    Prefixes of different lengths never collide, so each length is one round: of the symbols
    without a handle, the lowest id takes each prefix.
    """
    left, out = staged(hashes, "codes"), None
    for n in range(2, longest + 1):
        prefix = F.substring("code", 1, n)
        won = staged(left.groupBy(prefix.alias("handle")).agg(F.min("symbol_id").alias("symbol_id")).select("symbol_id", "handle"), "handles")
        out = won if out is None else out.unionAll(won)
        left = staged(left.join(won.select("symbol_id"), "symbol_id", "left_anti"), "codes")
        if left.isEmpty():
            break
    return out


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))

"""What production calls, never calls, and how a subtree looks: one pass of conditional counts each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators.edges import members
from factloom.operators.search import unattributed, under


def caller_counts(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, callers, prod_callers, test_callers) over call edges."""
    caller = symbols.select(F.col("id").alias("src"), F.col("def_file_id").alias("file"))
    test = F.coalesce("is_test", F.lit(False))
    rows = edges.where(F.col("kind") == S.CALLS).select("src", "dst").join(caller, "src").join(files.select(F.col("id").alias("file"), "is_test"), "file", "left")
    return rows.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count(F.when(~test, 1)).alias("prod_callers"), F.count(F.when(test, 1)).alias("test_callers"))


def dispatched(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(id): symbols that a service binding serves, themselves or through their type."""
    bound = links.where(F.col("role") == S.SERVES).select(F.col("symbol_id").alias("id")).distinct()
    through = members(symbols).join(bound.withColumnRenamed("id", "type_id"), "type_id", "left_semi").select(F.col("member_id").alias("id"))
    return bound.unionAll(through).distinct()


def _scope(symbols: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    where = files.where(under(prefix) & ~F.col("generated")).select(F.col("id").alias("def_file_id"), "path", "is_test")
    return symbols.where(F.col("kind").isin(S.TYPE, S.METHOD)).join(where, "def_file_id")


def unreached(symbols: DataFrame, files: DataFrame, edges: DataFrame, occ: DataFrame, links: DataFrame, prefix: str = "") -> DataFrame:
    """(id, path, test_callers, prod_refs, ref_count) of production code that production never calls.

    Dispatched symbols and constructors are not findings.  ``prod_refs`` counts references in
    hand-written production files that are not calls by name.
    """
    scope = _scope(symbols, files, prefix).where(~F.coalesce("is_test", F.lit(False)) & ~F.col("name").isin("__init__", "__new__"))
    scope = scope.join(dispatched(symbols, links), "id", "left_anti").join(caller_counts(edges, symbols, files), "id", "left")
    scope = scope.where(F.coalesce("prod_callers", F.lit(0)) == 0)
    own = files.where("not generated and not coalesce(is_test, false)").select(F.col("id").alias("file_id"))
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).join(own, "file_id", "left_semi").groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("prod_refs"))
    out = scope.join(refs, "id", "left")
    return out.select("id", "path", F.coalesce("test_callers", F.lit(0)).alias("test_callers"), F.coalesce("prod_refs", F.lit(0)).alias("prod_refs"), "ref_count")


def outline(symbols: DataFrame, files: DataFrame, edges: DataFrame, links: DataFrame, prefix: str = "") -> DataFrame:
    """(id, path, def_line, callers, prod_callers, dispatched) of the types and callables under a path."""
    flag = dispatched(symbols, links).withColumn("dispatched", F.lit(True))
    out = _scope(symbols, files, prefix).join(caller_counts(edges, symbols, files), "id", "left").join(flag, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", "path", "def_line", zero("callers"), zero("prod_callers"), F.coalesce("dispatched", F.lit(False)).alias("dispatched"))


def verify_counts(files: DataFrame, symbols: DataFrame, occ: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; every table is read once."""
    n = lambda cond: F.count(F.when(cond, 1))
    f = files.agg(F.count("*").alias("files"), n(F.col("generated")).alias("generated_files"), n(F.col("is_test")).alias("test_files"))
    s = symbols.agg(F.count("*").alias("symbols"), n(F.col("def_file_id").isNull()).alias("undefined"), n(F.col("ref_count") == 0).alias("unreferenced"), n(F.col("def_end_line").isNull()).alias("bodiless"), n(F.col("def_generated")).alias("generated_symbols"), n(F.col("doc").isNotNull()).alias("documented"))
    o = occ.agg(F.count("*").alias("occurrences"), n(F.col("role").bitwiseAND(1) == 1).alias("definitions"), n(F.col("role").bitwiseAND(2) == 2).alias("imports"))
    e = edges.agg(*(n(F.col("kind") == kind).alias(name) for kind, name in ((S.CALLS, "calls"), (S.MEMBER, "members"), (S.IMPLEMENTS, "implements"), (S.WEAK_REF, "weak"))))
    a = ambiguous(occ).agg(F.count("*").alias("ambiguous"))
    u = unattributed(symbols, edges).agg(F.coalesce(F.sum("unattributed"), F.lit(0)).alias("unattributed"))
    return f.join(s).join(o).join(e).join(a).join(u)  # one row each


def layer_counts(edges: DataFrame) -> DataFrame:
    """(kind, source, edges) of every relation and how it is known."""
    return edges.groupBy("kind", "source").agg(F.count("*").alias("edges"))


def concentrated(occ: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, path, uses) of symbols with two references or more that all lie in one file."""
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    one = refs.groupBy("symbol_id").agg(F.min("path").alias("path"), F.max("path").alias("last"), F.count("*").alias("uses"))
    return one.where("path = last and uses > 1").drop("last")


def change_candidates(symbols: DataFrame, limit: int = 40) -> DataFrame:
    """Hand-written symbols that most refer to, the most referenced first."""
    return symbols.where(~F.col("def_generated") & F.col("def_file_id").isNotNull()).orderBy(F.desc("ref_count"), "id").limit(limit)


def structure(symbols: DataFrame, files: DataFrame, prefix: str = "") -> DataFrame:
    """(path, def_line, id, name, kind) of what files define, without parameters."""
    where = files.where(under(prefix)).select(F.col("id").alias("def_file_id"), "path")
    return symbols.where(~F.col("kind").isin(S.TYPE_PARAMETER, S.PARAMETER)).join(where, "def_file_id").select("path", "def_line", "id", "name", "kind")


def unindexed(tree: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, files) of uppermost folders of the tree (path) none of whose files is in the index: unchecked, not empty."""
    folder = F.substring_index("path", "/", 1)
    seen = files.select(folder.alias("folder")).distinct()
    return tree.groupBy(folder.alias("folder")).agg(F.count("*").alias("files")).join(seen, "folder", "left_anti")


def ambiguous(occ: DataFrame) -> DataFrame:
    """(symbol_id, files): symbols defined in several files."""
    return occ.where(F.col("role").bitwiseAND(1) == 1).groupBy("symbol_id").agg(F.count_distinct("file_id").alias("files")).where("files > 1")

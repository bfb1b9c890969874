"""Finding symbols and what refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.edges import inside, spans

HOMONYMS = 200


def _rank(needle: str) -> list[Column]:
    return [
        F.desc(F.col("name") == needle),
        F.desc(F.col("name").ilike(f"{needle}%")),
        F.asc("def_generated"),
        F.asc(F.col("def_file_id").isNull()),
        F.asc(F.length("name")),
        F.desc("ref_count"),
        F.asc("id"),
    ]


def symbol_search(symbols: DataFrame, needle: str, limit: int) -> DataFrame:
    """Symbols whose name holds *needle* in any case (``%`` and ``_`` are wildcards), best first."""
    return symbols.where(F.col("name").ilike(f"%{needle}%")).orderBy(*_rank(needle)).limit(limit)


def symbols_named(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly this name among the best HOMONYMS hits."""
    return symbol_search(symbols, name, HOMONYMS).where(F.col("name") == name)


def under(prefix: str) -> Column:
    """Paths that start with a prefix, whose trailing slashes do not count."""
    return F.col("path").ilike(prefix.rstrip("/") + "%")


def references(occ: DataFrame, symbols: DataFrame, files: DataFrame, generated: bool = False) -> DataFrame:
    """(symbol_id, path, line, col_start, role, generated, enclosing): every reference with the name of the innermost body around it."""
    where = files.select(F.col("id").alias("file_id"), "path", "generated")
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).join(where, "file_id")
    if not generated:
        refs = refs.where(~F.col("generated"))
    held = inside(refs.select("file_id", "line").distinct(), spans(symbols, "name"))
    inner = held.groupBy("p.file_id", "p.line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "encl", "name")).alias("i"))
    out = refs.join(inner.select("file_id", "line", F.col("i.name").alias("enclosing")), ["file_id", "line"], "left")
    return out.select("symbol_id", "path", "line", "col_start", "role", "generated", "enclosing")


def suppressed(occ: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, shown, generated): references in hand-written and in generated files."""
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).join(files.select(F.col("id").alias("file_id"), F.col("generated").alias("g")), "file_id")
    return refs.groupBy("symbol_id").agg(F.count(F.when(~F.col("g"), 1)).alias("shown"), F.count(F.when(F.col("g"), 1)).alias("generated"))


def usage_by_file(occ: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, path, is_test, uses) in hand-written files."""
    where = files.where("not generated").select(F.col("id").alias("file_id"), "path", "is_test")
    return occ.where(F.col("role").bitwiseAND(1) == 0).join(where, "file_id").groupBy("symbol_id", "path", "is_test").agg(F.count("*").alias("uses"))


def usage_in_tests(occ: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, uses, files) over test files."""
    return usage_by_file(occ, files).where("is_test").groupBy("symbol_id").agg(F.sum("uses").alias("uses"), F.count("*").alias("files"))


def unattributed(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, unattributed): references that no call edge accounts for."""
    calls = edges.where("kind = 0").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls"))
    return symbols.join(calls, "id", "left").select("id", F.greatest(F.col("ref_count") - F.coalesce("calls", F.lit(0)), F.lit(0)).alias("unattributed"))


def known_calls(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, name): identifiers of five bytes or more before a parenthesis that name a hand-written type or callable."""
    names = symbols.where(F.col("kind").isin(1, 3) & ~F.col("def_generated")).select("name").distinct()
    called = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    seen = lines.select("path", "line", F.explode(F.array_distinct(called)).alias("name")).where(F.octet_length("name") >= 5)
    return seen.join(names, "name", "left_semi")


def tree_search(lines: DataFrame, needle: str, context: int = 2) -> DataFrame:
    """(path, line, text, before, after): lines that hold *needle* in any case, with *context* lines around.

    Lines around a hit are found by joining line numbers, not by a window over whole files.
    """
    hits = lines.where(F.lower("text").contains(needle.lower())).select("path", F.col("line").alias("hit"), F.col("text").alias("hit_text"))
    near = hits.select("path", "hit", "hit_text", F.explode(F.sequence(F.col("hit") - context, F.col("hit") + context)).alias("line")).where("line <> hit")
    around = near.join(lines.select("path", "line", "text"), ["path", "line"], "left").groupBy("path", "hit", "hit_text")
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & F.col("text").isNotNull(), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return around.agg(text(F.col("line") < F.col("hit")).alias("before"), text(F.col("line") > F.col("hit")).alias("after")).select("path", F.col("hit").alias("line"), F.col("hit_text").alias("text"), "before", "after")


def residue(hits: DataFrame, accounted: DataFrame) -> DataFrame:
    """Hits (path, line) that no resolved reference accounts for."""
    return hits.join(accounted.select("path", "line").distinct(), ["path", "line"], "left_anti")


def completeness(mentions: DataFrame, accounted: DataFrame, strings: DataFrame) -> DataFrame:
    """(name, bucket, mentions): every mention (path, line, name, text) of a name in one bucket.

    ``accounted``: a resolved reference lies on its line; ``string``: a literal does;
    ``attribute``: it follows a dot, which indexers resolve for few; ``unexplained``: the rest.
    The names must each be borne by one symbol, as a homonym's mentions can't be told apart.
    """
    at = lambda df, name: df.select("path", "line", F.lit(True).alias(name)).distinct()
    rows = mentions.join(at(accounted, "known"), ["path", "line"], "left").join(at(strings, "quoted"), ["path", "line"], "left")
    dotted = F.contains("text", F.concat(F.lit("."), F.col("name")))
    bucket = F.when(F.col("known"), "accounted").when(F.col("quoted"), "string").when(dotted, "attribute").otherwise("unexplained")
    return rows.groupBy("name", bucket.alias("bucket")).agg(F.count("*").alias("mentions"))


def within_budget(rows: DataFrame, order: list, cost: str, tokens: int, by: str | None = None) -> DataFrame:
    """The first rows whose lines fit *tokens* of 3.7 characters, newline included; the first always fits."""
    from pyspark.sql import Window as W

    over = W.partitionBy(by) if by else W.partitionBy(F.lit(0))
    running = over.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"spent": F.ceil(F.sum(F.col(cost) + 1).over(running) / 3.7), "row": F.row_number().over(over.orderBy(*order))})
    return rows.where((F.col("spent") <= tokens) | (F.col("row") == 1)).drop("row")

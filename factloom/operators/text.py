"""Literals, weak links, documentation sections and concept scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import scalar as X
from factloom.operators.edges import inside, ranked, spans

HOMONYMS, HITS_PER_FILE, WEAK_CONFIDENCE = 8, 50, 0.3
FLOOR = 3.0
LEVELS = 6


def admitted(literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """(text, file_id, line, enclosing): literals worth a search, with the deepest body around each."""
    own = literals.where(X.is_admitted_literal(F.col("text"))).select("text", "file_id", "line").distinct()
    held = inside(own.select("file_id", "line").distinct(), spans(symbols)).groupBy("p.file_id", "p.line").agg(F.max(F.struct("start", (-F.col("encl")).alias("low"))).alias("d"))
    deepest = held.select("file_id", "line", (-F.col("d.low")).alias("enclosing"))
    return own.join(deepest, ["file_id", "line"], "left").select("text", "file_id", "line", "enclosing")


def literal_search(literals: DataFrame, files: DataFrame, needle: str) -> DataFrame:
    """Literals that hold *needle* in any case, with their path."""
    own = literals.where(F.lower("text").contains(needle.lower()))
    return own.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("text", "path", "line", "enclosing")


def weak_names(symbols: DataFrame) -> DataFrame:
    """(name, id): distinctive names of types and callables that at most HOMONYMS symbols bear."""
    own = symbols.where(F.col("kind").isin(S.TYPE, S.METHOD) & (F.length("name") >= 4) & X.is_distinctive(F.col("name")))
    return own.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where(F.col("n") <= HOMONYMS).select("name", "id")


def weak_links(literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """(dst, file_id, line, kind, source, confidence): literals that spell a name, whole or after the last of ``. / :``; the first HITS_PER_FILE of a file.

    Both lookups are one join over a literal's whole and tail; the whole wins.
    """
    names = weak_names(symbols)
    own = literals.where(F.octet_length("text") >= 4)
    tail = F.regexp_extract("text", r"([^./:]*)$", 1)
    tried = own.select("text", "file_id", "line", F.explode(F.array(F.struct(F.lit(0).alias("order"), F.col("text").alias("name")), F.struct(F.lit(1).alias("order"), tail.alias("name")))).alias("t"))
    met = tried.select("text", "file_id", "line", "t.order", "t.name").join(names, "name")
    one = met.groupBy("text", "file_id", "line").agg(F.min(F.struct("order", "id")).alias("m"))
    cut = ranked(one.select(F.col("m.id").alias("dst"), "file_id", "line", "text"), ["file_id"], [F.asc("line"), F.asc("text")]).where(F.col("rank") <= HITS_PER_FILE)
    return cut.select("dst", "file_id", "line", F.lit(S.WEAK_REF).alias("kind"), F.lit(S.WEAK).alias("source"), F.lit(WEAK_CONFIDENCE).alias("confidence"))


def weak_sites(links: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, path, line, is_test, confidence) of weak links."""
    where = files.select(F.col("id").alias("file_id"), "path", "is_test")
    return links.where(F.col("kind") == S.WEAK_REF).join(where, "file_id", "left").select(F.col("dst").alias("symbol_id"), "path", "line", "is_test", "confidence")


def section_spans(headings: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, level, heading, start_line, end_line): a section ends before the next heading of its level or above.

    A heading's level is 1 to LEVELS.  One sorted pass from a document's end keeps the nearest
    heading for each level, so headings are not paired.
    """
    later = Window.partitionBy("doc_id").orderBy(F.desc("start_line")).rangeBetween(Window.unboundedPreceding, -1)
    own = headings.select("doc_id", "level", "heading", "start_line").distinct()
    following = own.select("*", *[F.min(F.when(F.col("level") <= n, F.col("start_line"))).over(later).alias(f"next{n}") for n in range(1, LEVELS + 1)])
    after = F.coalesce(*[F.when(F.col("level") == n, F.col(f"next{n}")) for n in range(1, LEVELS + 1)])
    return following.join(files.select("doc_id", "lines"), "doc_id").select("doc_id", "level", "heading", "start_line", F.coalesce(after - 1, F.col("lines")).alias("end_line"))


def section_hits(lines: DataFrame, sections: DataFrame, needle: str) -> DataFrame:
    """(doc_id, start_line, heading, words, hits, in_heading) of sections that hold *needle*; a line counts for its deepest section.

    Sections of a level follow each other, so of each level only the last that began can hold a line:
    one sorted pass over a document keeps it, and lines are not paired with sections.
    """
    hit = lines.where(F.lower("text").contains(needle.lower())).select("doc_id", "line")
    none = F.lit(None)
    spots = sections.select("doc_id", F.col("start_line").cast("bigint").alias("line"), "level", F.col("end_line").cast("bigint").alias("end_line"), F.lit(0).alias("order"))
    spots = spots.unionByName(hit.select("doc_id", F.col("line").cast("bigint").alias("line"), none.cast("int").alias("level"), none.cast("bigint").alias("end_line"), F.lit(1).alias("order")))
    before = Window.partitionBy("doc_id").orderBy("line", "order").rowsBetween(Window.unboundedPreceding, 0)
    place = F.shiftleft("line", 32) + F.col("end_line")  # both at once, as a number
    last = {n: F.max(F.when(F.col("level") == n, place)).over(before) for n in range(LEVELS, 0, -1)}
    spots = spots.select("doc_id", "line", "order", *[c.alias(f"last{n}") for n, c in last.items()]).where("order = 1")
    start = F.coalesce(*[F.when(F.col(f"last{n}").bitwiseAND((1 << 32) - 1) >= F.col("line"), F.shiftright(f"last{n}", 32)) for n in last])
    deep = spots.select("doc_id", "line", start.cast("int").alias("start_line")).where("start_line is not null").distinct()
    counts = deep.groupBy("doc_id", "start_line").agg(F.count("*").alias("hits"))
    return sections.join(counts, ["doc_id", "start_line"]).select("doc_id", "start_line", "heading", "words", "hits", F.lower("heading").contains(needle.lower()).alias("in_heading"))


def sections_about(lines: DataFrame, sections: DataFrame, needle: str) -> DataFrame:
    """Sections (doc_id, start_line, heading, words, hits, in_heading, density) about *needle*.

    A section whose heading or trail holds it is about it, with or without a line that does; in
    all others it comes up, the more the denser: hits over words.
    """
    q = needle.lower()
    hit = section_hits(lines, sections, needle).select("doc_id", "start_line", "hits")
    named = F.lower("heading").contains(q) | F.lower(F.coalesce("trail", F.lit(""))).contains(q)
    rows = sections.join(hit, ["doc_id", "start_line"], "left").withColumn("in_heading", named).where("in_heading or hits is not null")
    density = F.col("hits") / F.greatest("words", F.lit(1))
    return rows.select("doc_id", "start_line", "end_line", "heading", "trail", "words", F.coalesce("hits", F.lit(0)).alias("hits"), "in_heading", F.when(~F.col("in_heading"), density).alias("density"))


def about_order() -> list[Column]:
    """Headings first, by place; then the densest, the shorter first on a tie."""
    place = lambda c: F.when(F.col("in_heading"), F.col(c))
    return [F.desc("in_heading"), place("path"), place("start_line"), F.desc("density"), F.asc("words"), F.asc("path"), F.asc("start_line")]


def documents(sections: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path, sections, words, top): headings at the uppermost level below the title, in order."""
    base = sections.where("level > 1").groupBy("doc_id").agg(F.min("level").alias("least"))
    top = sections.join(base, "doc_id").where("level = least").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "heading"))).alias("t"))
    sums = sections.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("words").alias("words"))
    out = files.join(sums, "doc_id", "left").join(top, "doc_id", "left")
    return out.select("doc_id", "path", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("words", F.lit(0)).alias("words"), F.transform("t", lambda x: x["heading"]).alias("top"))


def context_scores(symbols: DataFrame, files: DataFrame, query: str, concepts: DataFrame | None = None) -> DataFrame:
    """(id, score, sources): symbols that a query is about, by concept links, names, modules, docs and tests."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    where = files.select(F.col("id").alias("def_file_id"), "is_test", F.col("generated").alias("g"))
    rows = symbols.where("def_file_id is not null").join(where, "def_file_id", "left")
    shape = F.when(F.col("kind") == S.TYPE, 1.6).when(F.col("kind") == S.METHOD, 1.4).when(F.col("kind") == S.NAMESPACE, 1.2).otherwise(0.35)
    base = (1 + F.least("ref_count", F.lit(50)) / 100) * F.when(F.coalesce("g", F.lit(False)), 0.05).otherwise(1.0) * shape
    name, module, doc = has("name"), has("module"), has("doc")
    exact = F.lower("name") == q
    seeds = rows.where(name | module | doc).select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("name").alias("source"), F.when(name | module, 4.0 * F.when(exact, 2.5 * base).otherwise(base)).alias("score")),
                F.struct(F.lit("doc").alias("source"), F.when(doc, 2.0 * 1.5 * base).alias("score")),
                F.struct(F.lit("test").alias("source"), F.when(F.coalesce("is_test", F.lit(False)) & (name | doc), F.lit(1.5 * 0.6)).alias("score")),
            )
        ).alias("s"),
    )
    seeds = seeds.select("id", "s.source", "s.score").where("score is not null")
    if concepts is not None:
        seeds = seeds.unionByName(concepts.select("id", F.lit("concept").alias("source"), F.lit(10.0).alias("score")))
    return seeds.groupBy("id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))

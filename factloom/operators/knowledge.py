"""Authored knowledge, coverage of languages, snapshots and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as X

LEAST_FILES, LEAST_SHARE = 5, 0.05


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both by key, the one with the highest *version* (new before old on a tie).

    Grouping by the key with a map-side maximum keeps one row per key and task.
    """
    names = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy(*key).agg(F.max(F.struct(version, "_new", *[n for n in names if n not in {version, *key}])).alias("r"))
    return last.select(*[F.col(n) if n in key else F.col(f"r.{n}").alias(n) for n in names])


def resolve_links(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links (.., symbol_hash) with the id of the symbol now, null if it is gone."""
    return links.join(symbols.select(F.col("hash").alias("symbol_hash"), F.col("id").alias("symbol_id")), "symbol_hash", "left")


def dangling(links: DataFrame, symbols: DataFrame) -> DataFrame:
    return links.join(symbols.select(F.col("hash").alias("symbol_hash")), "symbol_hash", "left_anti")


def flag_stale(links: DataFrame, hashes: DataFrame) -> DataFrame:
    """Links (.., anchor_path, anchor_hash) that need a review since their file changed or went."""
    now = hashes.select(F.col("path").alias("anchor_path"), F.col("content_hash").alias("now"))
    return links.join(now, "anchor_path", "left").withColumn("needs_review", F.col("anchor_path").isNotNull() & ~F.col("now").eqNullSafe(F.col("anchor_hash"))).drop("now")


def asserted(links: DataFrame, symbol_id: int) -> DataFrame:
    """Authored links of a symbol, in either direction."""
    return links.where((F.col("src") == symbol_id) | (F.col("dst") == symbol_id)).orderBy("src", "dst", "note")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): modified, removed or created between two (path, content_hash) tables."""
    b, a = before.select("path", F.col("content_hash").alias("b")), after.select("path", F.col("content_hash").alias("a"))
    state = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return b.join(a, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def overlay_diff(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, name, state): added, moved or gone between live symbols and indexed ones (path, name, line)."""
    a, b = live.select("path", "name", F.col("line").alias("now")), indexed.select("path", "name", F.col("line").alias("was"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("was"), "moved")
    return a.join(b, ["path", "name"], "full_outer").select("path", "name", state.alias("state")).where("state is not null")


def language_shares(paths: DataFrame) -> DataFrame:
    """(ext, files, share, kept): extensions with at least LEAST_FILES files and LEAST_SHARE of all; totals come from one extra row."""
    counts = paths.groupBy("ext").agg(F.count("*").alias("files"))
    total = counts.agg(F.sum("files").alias("total"))
    share = F.col("files") / F.col("total")
    return counts.join(F.broadcast(total)).select("ext", "files", share.alias("share"), ((F.col("files") >= LEAST_FILES) & (share >= LEAST_SHARE)).alias("kept"))


def language_coverage(tree: DataFrame, indexed: DataFrame) -> DataFrame:
    """(lang, files, symbols, state) of languages in the tree or in the index."""
    t = tree.groupBy(X.normalise_lang(F.col("lang")).alias("lang")).agg(F.sum("files").alias("files"))
    i = indexed.groupBy(X.normalise_lang(F.col("lang")).alias("lang")).agg(F.sum("symbols").alias("symbols"))
    state = F.when(F.col("symbols").isNull(), "NotIndexed").when(F.col("files").isNull(), "IndexedOnly").otherwise("Indexed")
    return t.join(i, "lang", "full_outer").select("lang", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"), state.alias("state"))


def standings(checks: DataFrame, verdicts: DataFrame, head: str | None) -> DataFrame:
    """(check_id, area, standing): Open, Broken, Current or Expired; a verdict without a commit has expired."""
    v = verdicts.select("check_id", "holds", "commit_sha")
    standing = (
        F.when(F.col("holds").isNull(), "Open")
        .when(~F.col("holds"), "Broken")
        .when(F.col("commit_sha").eqNullSafe(F.lit(head)) & F.col("commit_sha").isNotNull(), "Current")
        .otherwise("Expired")
    )
    return checks.join(v, "check_id", "left").select("check_id", "area", standing.alias("standing"))


def apply_verdicts(areas: DataFrame, standing: DataFrame) -> DataFrame:
    """(area, state): an indexed area is Failing by one broken check, Verified if all are current, VerifyStale if one expired."""
    seen = standing.groupBy("area").agg(
        F.bool_or(F.col("standing") == "Broken").alias("broken"), F.bool_and(F.col("standing") == "Current").alias("current"), F.bool_or(F.col("standing") == "Expired").alias("expired")
    )
    state = F.when(F.col("broken"), "Failing").when(F.col("state") != "Indexed", F.col("state")).when(F.col("current"), "Verified").when(F.col("expired"), "VerifyStale").otherwise(F.col("state"))
    return areas.join(seen, "area", "left").select("area", state.alias("state"))


def verification_checks(pivot: DataFrame, entries: DataFrame) -> DataFrame:
    """(check_id, area, claim): what a reader could confirm: each linked service's counts, and each resolved entrypoint."""
    linked = pivot.where("serves + calls > 0").select(
        F.concat(F.lit("service-"), F.col("service_id").cast("string")).alias("check_id"),
        F.lit("cross-api").alias("area"),
        F.format_string("%d symbols serve it, %d call it", "serves", "calls").alias("claim"),
    )
    started = entries.where("entry_file is not null").select(F.concat(F.lit("entry-"), X.slug(F.col("service"))).alias("check_id"), F.lit("entrypoints").alias("area"), F.concat(F.lit("starts in file "), F.col("entry_file").cast("string")).alias("claim"))
    return linked.unionAll(started.distinct())


def coverage_areas(entries: DataFrame, links: DataFrame, protos: int) -> DataFrame:
    """(area, known, total, state) of entrypoints and of service links, before verdicts.

    Nothing to resolve is NotApplicable, nothing resolved NotCovered, some Partial, all Indexed.
    """
    def state(known, total, absent="NotApplicable"):  # noqa: ANN001, ANN202
        return F.when(total == 0, absent).when(known == 0, "NotCovered").when(known < total, "Partial").otherwise("Indexed")

    e = entries.agg(F.lit("entrypoints").alias("area"), F.count("entry_file").alias("known"), F.count("*").alias("total"))
    sides = links.groupBy("service_id").agg(F.max(F.when(F.col("role") == 0, 1).otherwise(0)).alias("served"), F.max(F.when(F.col("role") == 1, 1).otherwise(0)).alias("called"))
    absent = "NotApplicable" if not protos else "NotIndexed"
    s = sides.agg(F.lit("cross-api").alias("area"), F.count(F.when(F.col("served") + F.col("called") == 2, 1)).alias("known"), F.count("*").alias("total"))
    return e.withColumn("state", state(F.col("known"), F.col("total"))).unionAll(s.withColumn("state", state(F.col("known"), F.col("total"), absent)))


def hit_classes(hits: DataFrame) -> DataFrame:
    """(class, hits) of text hits (is_test, generated, path): tests, generated, docs, hand-written."""
    kind = F.when(F.col("is_test"), "tests").when(F.col("generated"), "generated").when(F.col("path").endswith(".md"), "docs").otherwise("hand-written")
    return hits.groupBy(kind.alias("class")).agg(F.count("*").alias("hits"))

"""Knowledge that people and agents write: concepts, links, verdicts.  It is kept outside builds, by symbol hash."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import sinks
from factloom.operators import knowledge

CONCEPTS = "ns string, name string, note string, author int, at timestamp"
LINKS = "ns string, name string, symbol_hash string, rel string, note string, anchor_path string, anchor_hash string, at timestamp"
ASSERTED = "src_hash string, dst_hash string, rel string, note string, at timestamp"
VERDICTS = "check_id string, area string, holds boolean, note string, commit_sha string, at timestamp"
DEFAULT_NS = "agent"


class Authored:
    """Authored tables beside the builds under *root*; the last write of a key wins."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root}/authored"

    def _table(self, name: str, schema: str) -> DataFrame:
        rows = sinks.read_table(self.spark, f"{self.root}/{name}", schema)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def _put(self, name: str, schema: str, row: tuple, key: list[str]) -> None:
        new = self.spark.createDataFrame([(*row, dt.datetime.now())], schema)
        sinks.upsert_table(self.spark, f"{self.root}/{name}", new, key, "at")

    def add_concept(self, name: str, note: str = "", ns: str = DEFAULT_NS, author: int = 2) -> None:
        self._put("concepts", CONCEPTS, (ns, name, note, author), ["ns", "name"])

    def link_concept(self, name: str, symbol: DataFrame, rel: str = "about", note: str = "", ns: str = DEFAULT_NS) -> None:
        """Tie a concept to one symbol, a row with hash, path and content_hash."""
        r = symbol.select("hash", "path", "content_hash").first()
        self._put("concept_links", LINKS, (ns, name, r["hash"], rel, note, r["path"], r["content_hash"]), ["ns", "name", "symbol_hash", "rel"])

    def concepts(self, ns: str | None = None) -> DataFrame:
        """(ns, name, note, links) in order."""
        rows = self._table("concepts", CONCEPTS)
        n = self._table("concept_links", LINKS).groupBy("ns", "name").agg(F.count("*").alias("links"))
        rows = rows.join(n, ["ns", "name"], "left").select("ns", "name", "note", F.coalesce("links", F.lit(0)).alias("links"))
        return (rows.where(F.col("ns") == ns) if ns else rows).orderBy("ns", "name")

    def concept_links(self, symbols: DataFrame, files: DataFrame, name: str | None = None) -> DataFrame:
        """Links with the symbol's id now (null if it is gone) and whether they need a review."""
        rows = self._table("concept_links", LINKS)
        rows = rows.where(F.col("name") == name) if name else rows
        return knowledge.flag_stale(knowledge.resolve_links(rows, symbols.select("hash", "id")), files.select("path", "content_hash"))

    def seeds(self, symbols: DataFrame, query: str) -> DataFrame:
        """(id): symbols now that concepts whose name or note holds *query* in any case are tied to."""
        q = query.lower()
        about = self._table("concepts", CONCEPTS).where(F.lower("name").contains(q) | F.lower(F.coalesce("note", F.lit(""))).contains(q)).select("ns", "name")
        tied = self._table("concept_links", LINKS).join(about, ["ns", "name"], "left_semi")
        return knowledge.resolve_links(tied, symbols.select("hash", "id")).where("symbol_id is not null").select(F.col("symbol_id").alias("id")).distinct()

    def drop_namespace(self, ns: str) -> None:
        """Remove a namespace's concepts and links; the default one is never dropped."""
        if ns == DEFAULT_NS:
            raise ValueError("the default namespace is not dropped")
        for name, schema in (("concepts", CONCEPTS), ("concept_links", LINKS)):
            path = f"{self.root}/{name}"
            if sinks.read_table(self.spark, path, schema) is not None:
                sinks.replace_table(self.spark, path, lambda old: old.where(F.col("ns") != ns))

    def assert_link(self, src_hash: str, dst_hash: str, rel: str = "calls", note: str = "") -> None:
        self._put("asserted", ASSERTED, (src_hash, dst_hash, rel, note), ["src_hash", "dst_hash", "rel"])

    def asserted(self, symbols: DataFrame, symbol_id: int) -> DataFrame:
        """Links of a symbol in either direction, by the ids of now."""
        ids = symbols.select("hash", "id")
        rows = self._table("asserted", ASSERTED)
        rows = rows.join(ids.select(F.col("hash").alias("src_hash"), F.col("id").alias("src")), "src_hash", "left").join(ids.select(F.col("hash").alias("dst_hash"), F.col("id").alias("dst")), "dst_hash", "left")
        return knowledge.asserted(rows.select("src", "dst", "rel", "note"), symbol_id)

    def record_verdict(self, check_id: str, area: str, holds: bool, note: str = "", commit: str | None = None) -> None:
        self._put("verifications", VERDICTS, (check_id, area, holds, note, commit), ["check_id"])

    def verdicts(self) -> DataFrame:
        return self._table("verifications", VERDICTS).orderBy("area", "check_id")

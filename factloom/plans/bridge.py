"""Fact tables seen through the driver's star schema, in DataFrames and in SQL.

Suppliers are files, parts are symbols, line items are occurrences; every operator can so be
run at volume and compared.  ``SQL`` holds the same views as common table expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import edges as E
from factloom.stage import staged


@dataclass
class Facts:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(
            F.col("s_suppkey").alias("id"),
            F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"),
            (F.col("s_suppkey") % 4).cast("int").alias("lang"),
            (F.col("s_acctbal") < 0).alias("generated"),
            (F.col("s_suppkey") % 5 == 0).alias("is_test"),
            F.sha2(F.col("s_name"), 256).alias("content_hash"),
            F.col("n_nationkey").cast("bigint").alias("nation"),
            F.col("r_name").alias("region"),
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        role = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0)
        end = F.when(role == 1, F.col("l_orderkey") + 20 * F.col("l_quantity").cast("bigint"))
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("file_id"), F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("col_start"), role.alias("role"), end.alias("enc_end")
        )

    @cached_property
    def parts(self) -> DataFrame:
        kind = (F.col("p_size") % 8).cast("int")
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.when(kind == S.TYPE, F.col("p_brand")).otherwise(F.col("p_name")).alias("name"),
            F.col("p_type").alias("module"),
            F.col("p_brand").alias("container_leaf"),
            kind.alias("kind"),
            (F.col("p_partkey") % 4).cast("int").alias("lang"),
            F.sha2(F.col("p_partkey").cast("string"), 256).alias("hash"),
            F.lit(None).cast("string").alias("doc"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        out = E.finalize(self.parts, self.occurrences, self.files)
        return staged(out.withColumn("def_end_line", F.when(F.col("kind").isin(S.TYPE, S.METHOD), F.col("def_end_line"))), "symbols")

    @cached_property
    def edges(self) -> DataFrame:
        return staged(E.all_edges(self.occurrences, self.symbols), "edges")

    @cached_property
    def part_edges(self) -> DataFrame:
        """Parts that follow each other in an order: the dense graph."""
        from pyspark.sql import Window as W

        after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
        rows = self.table("lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null").distinct()
        return rows.select("src", "dst", F.lit(0).alias("kind"), F.lit(0).alias("source"), F.lit(1.0).alias("confidence"), F.lit(None).cast("bigint").alias("file_id"), F.lit(0).cast("bigint").alias("line"))

    @cached_property
    def links(self) -> DataFrame:
        """Types bound to one of five services; odd ones call it through themselves as the client."""
        types = self.symbols.where(F.col("kind") == S.TYPE)
        return types.select((F.col("id") % 5).alias("service_id"), F.col("id").alias("symbol_id"), (F.col("id") % 2).cast("int").alias("role"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("via_symbol"))

    @cached_property
    def services(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("pkg"), F.col("n_regionkey").cast("string")).alias("pkg"), F.col("n_name").alias("name"))

    @cached_property
    def entries(self) -> DataFrame:
        """Regions as deployed services; every seventh supplier is an entry file of its region."""
        return self.files.where("id % 7 = 1").select(F.col("region").alias("service"), F.col("id").alias("entry_file"))

    @cached_property
    def literals(self) -> DataFrame:
        text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("pkg."), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.col("p_type"))
        return self.table("part").select(text.alias("text"), (F.col("p_partkey") % 100).cast("bigint").alias("file_id"), (F.col("p_partkey") * 7).cast("bigint").alias("line"))

    @cached_property
    def markdown(self) -> DataFrame:
        """(path, text): events as headings of 200 documents, each followed by a line of two words."""
        e = self.table("events")
        at = F.struct(F.floor(F.col("event_id") / 200).alias("at"), F.concat(F.repeat(F.lit("#"), (1 + F.col("event_id") * 7 % 4).cast("int")), F.lit(" "), F.col("event_type"), F.lit("\nabout "), F.col("event_type")).alias("text"))
        rows = e.groupBy((F.col("event_id") % 200).cast("string").alias("path")).agg(F.array_sort(F.collect_list(at)).alias("t"))
        return rows.select("path", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


_BUILT: dict[tuple[str, str], Facts] = {}


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The facts of a folder; as in a fact base, symbols and edges are derived once and then read by all queries of an application."""
    return _BUILT.setdefault((spark.sparkContext.applicationId, sf_dir), Facts(spark, sf_dir))


def reset() -> None:
    """Forget what was derived, so that the next query derives it from the folder as it is then."""
    _BUILT.clear()


#: The same views for DuckDB; names that a query does not use cost nothing.
SQL = """
WITH RECURSIVE files AS (
  SELECT s_suppkey AS id, concat_ws('/', r_name, n_name, s_name) AS path, CAST(s_suppkey % 4 AS INT) AS lang, s_acctbal < 0 AS generated,
    s_suppkey % 5 = 0 AS is_test, sha256(s_name) AS content_hash, CAST(n_nationkey AS BIGINT) AS nation, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), occ AS (
  SELECT l_suppkey AS file_id, l_partkey AS symbol_id, l_orderkey AS line, l_linenumber AS col_start,
    CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS role,
    CASE WHEN l_returnflag = 'R' THEN l_orderkey + 20 * CAST(l_quantity AS BIGINT) END AS enc_end
  FROM lineitem
), defs AS (
  SELECT symbol_id, file_id AS def_file_id, line AS def_line, col_start AS def_col_start, generated AS def_generated, enc_end AS def_end_line,
    row_number() OVER (PARTITION BY symbol_id ORDER BY generated, file_id, line, col_start, enc_end) AS rn
  FROM occ JOIN files ON files.id = occ.file_id WHERE role & 1 = 1
), refc AS (SELECT symbol_id, count(*) AS ref_count FROM occ WHERE role & 1 = 0 GROUP BY symbol_id
), symbols AS MATERIALIZED (
  SELECT p_partkey AS id, CASE WHEN p_size % 8 = 1 THEN p_brand ELSE p_name END AS name, p_type AS module, p_brand AS container_leaf,
    CAST(p_size % 8 AS INT) AS kind, CAST(p_partkey % 4 AS INT) AS lang, sha256(CAST(p_partkey AS VARCHAR)) AS hash,
    coalesce(ref_count, 0) AS ref_count, def_file_id, def_line, def_col_start, coalesce(def_generated, false) AS def_generated,
    CASE WHEN p_size % 8 IN (1, 3) THEN def_end_line END AS def_end_line
  FROM part LEFT JOIN refc ON refc.symbol_id = p_partkey LEFT JOIN defs ON defs.symbol_id = p_partkey AND defs.rn = 1
), bodies AS (SELECT id, def_file_id, def_line, def_end_line FROM symbols WHERE def_end_line IS NOT NULL
), calls AS MATERIALIZED (
  SELECT src, dst, file_id, line FROM (
    SELECT b.id AS src, o.symbol_id AS dst, o.file_id, o.line,
      row_number() OVER (PARTITION BY o.file_id, o.line, o.col_start, o.symbol_id ORDER BY b.def_end_line - b.def_line, b.id) AS rn
    FROM occ o JOIN bodies b ON b.def_file_id = o.file_id AND o.line BETWEEN b.def_line AND b.def_end_line AND b.id <> o.symbol_id
    WHERE o.role & 3 = 0) WHERE rn = 1
), binders AS MATERIALIZED (
  SELECT src, dst, file_id, line FROM (
    SELECT s.id AS src, o.symbol_id AS dst, o.file_id, o.line,
      row_number() OVER (PARTITION BY o.file_id, o.line, o.col_start, o.symbol_id ORDER BY s.def_col_start, s.id) AS rn
    FROM occ o JOIN symbols s ON s.def_file_id = o.file_id AND s.def_line = o.line AND s.id <> o.symbol_id
    WHERE o.role & 1 = 0 AND NOT EXISTS (
      SELECT 1 FROM bodies b WHERE b.def_file_id = o.file_id AND o.line BETWEEN b.def_line AND b.def_end_line AND b.id <> o.symbol_id)) WHERE rn = 1
), memb AS MATERIALIZED (
  SELECT t.id AS src, m.id AS dst, m.def_file_id AS file_id, m.def_line AS line
  FROM symbols t JOIN symbols m ON m.def_file_id = t.def_file_id AND m.container_leaf = t.name AND m.id <> t.id WHERE t.kind = 1
), edges AS MATERIALIZED (
  SELECT src, dst, 0 AS kind, 0 AS source, CAST(1.0 AS DOUBLE) AS confidence, file_id, line FROM calls
  UNION ALL SELECT src, dst, 0, 0, 1.0, file_id, line FROM binders UNION ALL SELECT src, dst, 4, 0, 1.0, file_id, line FROM memb
), dense AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL
), links AS (
  SELECT id % 5 AS service_id, id AS symbol_id, CAST(id % 2 AS INT) AS role, CASE WHEN id % 3 > 0 THEN id END AS via_symbol FROM symbols WHERE kind = 1
), services AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 'pkg' || n_regionkey AS pkg, n_name AS name FROM nation
), entries AS (SELECT region AS service, id AS entry_file FROM files WHERE id % 7 = 1
), lits AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'pkg.' || p_name WHEN 1 THEN p_name ELSE p_type END AS text, CAST(p_partkey % 100 AS BIGINT) AS file_id, CAST(p_partkey * 7 AS BIGINT) AS line FROM part
), doclines AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, CAST(i - 1 AS INT) AS line, parts[i] AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), heads AS MATERIALIZED (
  SELECT event_id % 200 AS doc_id, CAST(1 + (event_id * 7) % 4 AS INT) AS level, event_type AS heading, CAST(2 * (event_id // 200) + 1 AS INT) AS start_line FROM events
), sections AS MATERIALIZED (
  SELECT doc_id, level, heading, start_line, CAST(CASE level
    WHEN 1 THEN coalesce(min(start_line) FILTER (level <= 1) OVER w, 1 + max(start_line + 1) OVER (PARTITION BY doc_id)) WHEN 2 THEN coalesce(min(start_line) FILTER (level <= 2) OVER w, 1 + max(start_line + 1) OVER (PARTITION BY doc_id))
    WHEN 3 THEN coalesce(min(start_line) FILTER (level <= 3) OVER w, 1 + max(start_line + 1) OVER (PARTITION BY doc_id)) ELSE coalesce(min(start_line) FILTER (level <= 4) OVER w, 1 + max(start_line + 1) OVER (PARTITION BY doc_id)) END - 1 AS INT) AS end_line
  FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY start_line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), callers AS (
  SELECT e.dst AS id, count(*) AS callers, count(*) FILTER (NOT coalesce(f.is_test, false)) AS prod_callers, count(*) FILTER (coalesce(f.is_test, false)) AS test_callers
  FROM edges e JOIN symbols c ON c.id = e.src LEFT JOIN files f ON f.id = c.def_file_id WHERE e.kind = 0 GROUP BY e.dst
), dispatched AS (
  SELECT symbol_id AS id FROM links WHERE role = 0 UNION SELECT m.dst FROM memb m JOIN links l ON l.symbol_id = m.src AND l.role = 0
), owner AS MATERIALIZED (
  SELECT me.id, coalesce(
    (SELECT first(b.id ORDER BY b.def_end_line - b.def_line, b.id) FROM symbols b WHERE b.kind = 1 AND b.def_file_id = me.def_file_id AND b.id <> me.id AND b.def_end_line IS NOT NULL
       AND b.def_line <= me.def_line AND b.def_end_line >= coalesce(me.def_end_line, me.def_line)),
    (SELECT min(src) FROM memb WHERE dst = me.id)) AS type_id
  FROM symbols me WHERE me.def_file_id IS NOT NULL
), wirecalls AS MATERIALIZED (
  SELECT DISTINCT l.service_id, r.name AS rpc, replace(lower(r.name), '_', '') AS key, e.src AS caller_id
  FROM links l JOIN memb m ON m.src = l.via_symbol JOIN symbols r ON r.id = m.dst JOIN edges e ON e.dst = r.id AND e.kind = 0
    JOIN symbols c ON c.id = e.src JOIN files f ON f.id = c.def_file_id AND NOT f.generated WHERE l.role = 1
), wire AS MATERIALIZED (
  SELECT DISTINCT o.id AS method_id, w.service_id, w.rpc, w.caller_id
  FROM owner o JOIN links l ON l.symbol_id = o.type_id AND l.role = 0 JOIN symbols me ON me.id = o.id
    JOIN wirecalls w ON w.service_id = l.service_id AND w.key = replace(lower(me.name), '_', '') WHERE w.caller_id <> o.id
)
"""

"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar as X
from factloom.functions.symbols import parse_symbol
from factloom.operators import deploy, edges, graph, knowledge, search, services, survey, text
from factloom.plans.bridge import SQL, Facts, facts
from factloom.sources import code, markdown
from factloom.stage import staged
from factloom.streaming import dirty

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: bool = False):  # noqa: ANN201
    """Register a query over the bridge facts; *sql* follows the shared views unless it is *plain*."""

    def add(make: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: make(facts(spark, sf_dir))
        if sql:
            _ORACLES[name] = sql if plain else SQL + sql
        return make

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# -- relations --------------------------------------------------------------------------------


@query("call_edges", "SELECT * FROM calls")
def _(f: Facts) -> DataFrame:
    return edges.call_edges(f.occurrences, f.symbols)


@query("binder_edges", "SELECT * FROM binders")
def _(f: Facts) -> DataFrame:
    return edges.binder_edges(f.occurrences, f.symbols)


@query("member_edges", "SELECT * FROM memb")
def _(f: Facts) -> DataFrame:
    return edges.member_edges(f.symbols)


@query("definition_pick", "SELECT symbol_id, def_file_id, def_line, def_col_start, def_generated, def_end_line FROM defs WHERE rn = 1")
def _(f: Facts) -> DataFrame:
    return edges.definition_pick(f.occurrences, f.files)


_DUPLICATES = ", dup AS (SELECT * FROM occ UNION ALL SELECT file_id, symbol_id, line, col_start, role, NULL FROM occ WHERE symbol_id % 10 = 0)"


@query("dedupe_occurrences", _DUPLICATES + " SELECT symbol_id, file_id, line, col_start, role, min(enc_end) AS enc_end FROM dup GROUP BY ALL")
def _(f: Facts) -> DataFrame:
    again = f.occurrences.where("symbol_id % 10 = 0").withColumn("enc_end", F.lit(None).cast("bigint"))
    return edges.dedupe_occurrences(f.occurrences.unionAll(again))


@query("ref_counts", "SELECT * FROM refc")
def _(f: Facts) -> DataFrame:
    return edges.ref_counts(f.occurrences)


@query("enclosing_type", "SELECT id, type_id FROM owner WHERE type_id IS NOT NULL")
def _(f: Facts) -> DataFrame:
    return edges.enclosing_type(f.symbols)


@query("symbol_handles")
def _(f: Facts) -> DataFrame:
    codes = f.symbols.select(F.col("id").alias("symbol_id"), X.handle_text(X.symbol_hash(F.col("id").cast("string"))).alias("code"))
    return edges.handles(codes)


# -- search and usage ---------------------------------------------------------------------------

_SHOWN = "id, name, kind, ref_count"
_ORDER = "name = '{0}' DESC, name ILIKE '{0}%' DESC, def_generated, def_file_id IS NULL, length(name), ref_count DESC, id"


@query("symbol_search", f"SELECT {_SHOWN} FROM symbols WHERE name ILIKE '%ring%' ORDER BY {_ORDER.format('ring')} LIMIT 50")
def _(f: Facts) -> DataFrame:
    return search.symbol_search(f.symbols, "ring", 50).select("id", "name", "kind", "ref_count")


@query("symbols_named", f"SELECT * FROM (SELECT {_SHOWN} FROM symbols WHERE name ILIKE '%red widget%' ORDER BY {_ORDER.format('red widget')} LIMIT 200) WHERE name = 'red widget'")
def _(f: Facts) -> DataFrame:
    return search.symbols_named(f.symbols, "red widget").select("id", "name", "kind", "ref_count")


@query("path_scope", "SELECT id, path FROM files WHERE path ILIKE 'asia/nation_1%'")
def _(f: Facts) -> DataFrame:
    return f.files.where(search.under("asia/nation_1/")).select("id", "path")


@query(
    "refs_enclosing",
    """SELECT o.symbol_id, f.path, o.line, o.col_start, o.role, f.generated,
      (SELECT first(s.name ORDER BY s.def_end_line - s.def_line, s.id) FROM symbols s WHERE s.def_file_id = o.file_id AND s.def_end_line IS NOT NULL AND o.line BETWEEN s.def_line AND s.def_end_line) AS enclosing
    FROM occ o JOIN files f ON f.id = o.file_id WHERE o.role & 1 = 0 AND NOT f.generated""",
)
def _(f: Facts) -> DataFrame:
    return search.references(f.occurrences, f.symbols, f.files)


@query("refs_suppressed", "SELECT symbol_id, count(*) FILTER (NOT generated) AS shown, count(*) FILTER (generated) AS generated FROM occ JOIN files ON files.id = file_id WHERE role & 1 = 0 GROUP BY symbol_id")
def _(f: Facts) -> DataFrame:
    return search.suppressed(f.occurrences, f.files)


_USAGE = "SELECT symbol_id, path, is_test, count(*) AS uses FROM occ JOIN files ON files.id = file_id WHERE role & 1 = 0 AND NOT generated GROUP BY ALL"


@query("usage_by_file", _USAGE)
def _(f: Facts) -> DataFrame:
    return search.usage_by_file(f.occurrences, f.files)


@query("usage_in_tests", f"SELECT symbol_id, CAST(sum(uses) AS BIGINT) AS uses, count(*) AS files FROM ({_USAGE}) WHERE is_test GROUP BY symbol_id")
def _(f: Facts) -> DataFrame:
    return search.usage_in_tests(f.occurrences, f.files)


@query("unattributed_refs", "SELECT id, greatest(ref_count - coalesce(n, 0), 0) AS unattributed FROM symbols LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE kind = 0 GROUP BY dst) ON dst = id")
def _(f: Facts) -> DataFrame:
    return search.unattributed(f.symbols, f.edges)


@query(
    "tree_search_context",
    """, hits AS (SELECT * FROM doclines WHERE contains(lower(text), 'idiot'))
    SELECT h.path, h.line, h.text,
      coalesce((SELECT string_agg(x.text, chr(10) ORDER BY x.line) FROM doclines x WHERE x.doc_id = h.doc_id AND x.line BETWEEN h.line - 2 AND h.line - 1), '') AS before,
      coalesce((SELECT string_agg(x.text, chr(10) ORDER BY x.line) FROM doclines x WHERE x.doc_id = h.doc_id AND x.line BETWEEN h.line + 1 AND h.line + 2), '') AS after
    FROM hits h""",
)
def _(f: Facts) -> DataFrame:
    return search.tree_search(f.lines.select("path", "line", "text"), "idiot")


@query("residue", "SELECT path, line FROM doclines WHERE contains(lower(text), 'idiot') AND (doc_id, line) NOT IN (SELECT doc_id, line FROM doclines WHERE contains(lower(text), 'clown'))")
def _(f: Facts) -> DataFrame:
    low = f.lines.select("path", "line", F.lower("text").alias("t"))
    return search.residue(low.where(F.col("t").contains("idiot")).select("path", "line"), low.where(F.col("t").contains("clown")))


@query(
    "budget_prefix",
    """SELECT file_id, symbol_id, uses, CAST(spent AS BIGINT) AS spent FROM (
      SELECT file_id, symbol_id, uses, ceil(sum(length(CAST(symbol_id AS VARCHAR)) + 20 + 1) OVER w / 3.7) AS spent, row_number() OVER w AS rn
      FROM (SELECT file_id, symbol_id, count(*) AS uses FROM occ WHERE role & 1 = 0 GROUP BY ALL) WINDOW w AS (PARTITION BY file_id ORDER BY uses DESC, symbol_id ROWS UNBOUNDED PRECEDING)) WHERE spent <= 100 OR rn = 1""",
)
def _(f: Facts) -> DataFrame:
    rows = f.occurrences.where(F.col("role").bitwiseAND(1) == 0).groupBy("file_id", "symbol_id").agg(F.count("*").alias("uses"))
    rows = rows.withColumn("chars", F.length(F.col("symbol_id").cast("string")) + 20)
    return search.within_budget(rows, [F.desc("uses"), F.asc("symbol_id")], "chars", 100, "file_id").select("file_id", "symbol_id", "uses", "spent")


# -- survey -------------------------------------------------------------------------------------


@query(
    "unreached",
    """SELECT s.id, f.path, coalesce(c.test_callers, 0) AS test_callers,
      (SELECT count(*) FROM occ o JOIN files rf ON rf.id = o.file_id WHERE o.symbol_id = s.id AND o.role & 1 = 0 AND NOT rf.is_test AND NOT rf.generated) AS prod_refs, s.ref_count
    FROM symbols s JOIN files f ON f.id = s.def_file_id LEFT JOIN callers c ON c.id = s.id
    WHERE NOT f.generated AND NOT f.is_test AND s.kind IN (1, 3) AND s.name NOT IN ('__init__', '__new__') AND coalesce(c.prod_callers, 0) = 0 AND s.id NOT IN (SELECT id FROM dispatched)""",
)
def _(f: Facts) -> DataFrame:
    return survey.unreached(f.symbols, f.files, f.edges, f.occurrences, f.links)


@query(
    "outline",
    """SELECT s.id, f.path, s.def_line, coalesce(c.callers, 0) AS callers, coalesce(c.prod_callers, 0) AS prod_callers, s.id IN (SELECT id FROM dispatched) AS dispatched
    FROM symbols s JOIN files f ON f.id = s.def_file_id LEFT JOIN callers c ON c.id = s.id WHERE NOT f.generated AND s.kind IN (1, 3) AND f.path ILIKE 'asia%'""",
)
def _(f: Facts) -> DataFrame:
    return survey.outline(f.symbols, f.files, f.edges, f.links, "ASIA")


@query("ambiguous_defs", "SELECT symbol_id, count(DISTINCT file_id) AS files FROM occ WHERE role & 1 = 1 GROUP BY symbol_id HAVING count(DISTINCT file_id) > 1")
def _(f: Facts) -> DataFrame:
    return survey.ambiguous(f.occurrences)


@query(
    "verify_counts",
    """SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE generated) AS generated_files, (SELECT count(*) FROM files WHERE is_test) AS test_files,
      (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM symbols WHERE def_file_id IS NULL) AS undefined, (SELECT count(*) FROM symbols WHERE ref_count = 0) AS unreferenced,
      (SELECT count(*) FROM symbols WHERE def_end_line IS NULL) AS bodiless, (SELECT count(*) FROM occ) AS occurrences, (SELECT count(*) FROM occ WHERE role & 1 = 1) AS definitions,
      (SELECT count(*) FROM occ WHERE role & 2 = 2) AS imports, (SELECT count(*) FROM edges WHERE kind = 0) AS calls, (SELECT count(*) FROM edges WHERE kind = 4) AS members,
      (SELECT count(*) FROM edges WHERE kind = 1) AS implements, (SELECT count(*) FROM edges WHERE kind = 2) AS weak, (SELECT count(*) FROM symbols WHERE def_generated) AS generated_symbols, CAST(0 AS BIGINT) AS documented,
      (SELECT count(*) FROM (SELECT symbol_id FROM occ WHERE role & 1 = 1 GROUP BY symbol_id HAVING count(DISTINCT file_id) > 1)) AS ambiguous,
      (SELECT CAST(sum(greatest(ref_count - coalesce(n, 0), 0)) AS BIGINT) FROM symbols LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE kind = 0 GROUP BY dst) ON dst = id) AS unattributed""",
)
def _(f: Facts) -> DataFrame:
    return survey.verify_counts(f.files, f.symbols, f.occurrences, f.edges)


@query("layer_counts", "SELECT kind, source, count(*) AS edges FROM edges GROUP BY ALL")
def _(f: Facts) -> DataFrame:
    return survey.layer_counts(f.edges)


@query("concentrated", "SELECT symbol_id, min(path) AS path, count(*) AS uses FROM (SELECT symbol_id, role, CASE WHEN symbol_id % 9 = 0 THEN 1 ELSE file_id END AS file_id FROM occ) JOIN files ON files.id = file_id WHERE role & 1 = 0 GROUP BY symbol_id HAVING count(DISTINCT path) = 1 AND count(*) > 1")
def _(f: Facts) -> DataFrame:
    moved = f.occurrences.withColumn("file_id", F.when(F.col("symbol_id") % 9 == 0, 1).otherwise(F.col("file_id")))
    return survey.concentrated(moved, f.files)


@query("change_candidates", "SELECT id, ref_count FROM symbols WHERE NOT def_generated AND def_file_id IS NOT NULL ORDER BY ref_count DESC, id LIMIT 40")
def _(f: Facts) -> DataFrame:
    return survey.change_candidates(f.symbols).select("id", "ref_count")


@query("file_structure", "SELECT f.path, s.def_line, s.id, s.name, s.kind FROM symbols s JOIN files f ON f.id = s.def_file_id WHERE s.kind NOT IN (4, 5)")
def _(f: Facts) -> DataFrame:
    return survey.structure(f.symbols, f.files)


@query("unindexed_folders", "SELECT r_name AS folder, count(*) AS files FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey % 2 = 0 GROUP BY r_name")
def _(f: Facts) -> DataFrame:
    tree = f.table("nation").join(f.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    odd = f.table("region").where("r_regionkey % 2 = 1").select(F.col("r_name").alias("region"))
    return survey.unindexed(tree, f.files.join(odd, "region", "left_semi").unionByName(f.table("region").where("r_regionkey % 2 = 1").select(F.concat("r_name", F.lit("/x")).alias("path")), allowMissingColumns=True))


@query(
    "completeness",
    """SELECT 'idiot' AS name, CASE WHEN contains(lower(text), 'clown') THEN 'accounted' WHEN contains(lower(text), 'trash') THEN 'string' WHEN contains(lower(text), '.idiot') THEN 'attribute' ELSE 'unexplained' END AS bucket, count(*) AS mentions
    FROM doclines WHERE contains(lower(text), 'idiot') GROUP BY 2""",
)
def _(f: Facts) -> DataFrame:
    low = f.lines.select("path", "line", F.lower("text").alias("text"))
    return search.completeness(low.where(F.col("text").contains("idiot")).withColumn("name", F.lit("idiot")), low.where(F.col("text").contains("clown")), low.where(F.col("text").contains("trash")))


# -- walks --------------------------------------------------------------------------------------


@query(
    "neighbours_topk",
    """SELECT parent, other, rank, total FROM (SELECT dst AS parent, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank, count(*) OVER (PARTITION BY dst) AS total
      FROM (SELECT DISTINCT d.src, d.dst FROM dense d JOIN symbols s ON s.id = d.src)) WHERE rank <= 8""",
)
def _(f: Facts) -> DataFrame:
    return graph.neighbours(f.part_edges, f.symbols, f.files, fanout=8, paths=False).select("parent", "other", "rank", "total")


_FILTERED = """SELECT e.src AS parent, e.dst AS other, max(e.line) AS line FROM edges e JOIN symbols o ON o.id = e.dst JOIN files f ON f.id = o.def_file_id
    WHERE e.kind = 0 AND o.kind NOT IN (4, 5, 6, 7) AND NOT f.generated GROUP BY e.src, e.dst"""


@query("walk_calls_filtered", _FILTERED)
def _(f: Facts) -> DataFrame:
    return graph.neighbours(f.edges, f.symbols, f.files, outward=True, paths=False).select("parent", "other", "line")


_NEAR = """, near AS MATERIALIZED (SELECT parent, other, rank, total FROM (SELECT dst AS parent, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank, count(*) OVER (PARTITION BY dst) AS total
      FROM (SELECT DISTINCT d.src, d.dst FROM dense d JOIN symbols s ON s.id = d.src)) WHERE rank <= 4),
  l0 AS MATERIALIZED (SELECT id AS root, id AS node, 0 AS depth, CAST(NULL AS BIGINT) AS parent, CAST(1 AS BIGINT) AS pos FROM symbols),
  c1 AS (SELECT a.root, n.other AS node, 1 AS depth, a.node AS parent, a.pos AS before, n.rank FROM l0 a JOIN near n ON n.parent = a.node),
  l1 AS MATERIALIZED (SELECT root, node, depth, parent, row_number() OVER (PARTITION BY root ORDER BY before, rank) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY before, rank) AS k FROM c1) WHERE k = 1 AND (root, node) NOT IN (SELECT root, node FROM l0)),
  c2 AS (SELECT a.root, n.other AS node, 2 AS depth, a.node AS parent, a.pos AS before, n.rank FROM l1 a JOIN near n ON n.parent = a.node),
  l2 AS MATERIALIZED (SELECT root, node, depth, parent, row_number() OVER (PARTITION BY root ORDER BY before, rank) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY before, rank) AS k FROM c2) WHERE k = 1 AND (root, node) NOT IN (SELECT root, node FROM l0 UNION ALL SELECT root, node FROM l1)),
  nodes AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""


def _walked(f: Facts) -> tuple[DataFrame, DataFrame]:
    near = staged(graph.neighbours(f.part_edges, f.symbols, f.files, fanout=4, paths=False).select("parent", "other", "rank", "total"), "near")
    return graph.walk(f.symbols.select(F.col("id").alias("root")), near, 2), near


@query("walk_callers_d2", _NEAR + " SELECT root, node, depth, parent, pos FROM nodes")
def _(f: Facts) -> DataFrame:
    return _walked(f)[0]


@query(
    "walk_counts",
    _NEAR
    + """ SELECT n.root, count(DISTINCT n.node) AS nodes, coalesce(any_value(x.listed), 0) - count(DISTINCT n.node) + 1 AS revisited, coalesce(any_value(x.total), 0) - count(DISTINCT n.node) + 1 AS truncated
    FROM nodes n LEFT JOIN (SELECT a.root, CAST(sum(z.listed) AS BIGINT) AS listed, CAST(sum(z.total) AS BIGINT) AS total FROM nodes a
      JOIN (SELECT parent, count(*) AS listed, max(total) AS total FROM near GROUP BY parent) z ON z.parent = a.node WHERE a.depth < 2 GROUP BY a.root) x ON x.root = n.root GROUP BY n.root""",
)
def _(f: Facts) -> DataFrame:
    nodes, near = _walked(f)
    return graph.walk_counts(nodes, near, 2)


@query(
    "call_path_len",
    """, path AS (SELECT id AS root, id AS node, 0 AS depth FROM symbols WHERE id % 20 = 0
      UNION SELECT p.root, e.dst, p.depth + 1 FROM path p JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 0) e ON e.src = p.node WHERE p.depth < 8)
    SELECT root, node, min(depth) AS depth FROM path GROUP BY root, node""",
)
def _(f: Facts) -> DataFrame:
    roots = f.symbols.where("id % 20 = 0").select(F.col("id").alias("root"), F.col("id").alias("node"))
    return graph.distances(roots, f.edges.where("kind = 0"), 8)


@query(
    "tests_reaching",
    """, tests AS (SELECT s.id FROM symbols s JOIN files f ON f.id = s.def_file_id WHERE f.is_test), ce AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 0),
    inner_ AS (SELECT id AS root, id AS node, 0 AS depth FROM symbols WHERE id % 20 = 0
      UNION SELECT p.root, e.src, p.depth + 1 FROM inner_ p JOIN ce e ON e.dst = p.node WHERE p.depth < 2 AND e.src NOT IN (SELECT id FROM tests))
    SELECT p.root, e.src AS test_id, min(p.depth) + 1 AS depth FROM inner_ p JOIN ce e ON e.dst = p.node JOIN tests t ON t.id = e.src WHERE e.src <> p.root GROUP BY p.root, e.src""",
)
def _(f: Facts) -> DataFrame:
    return graph.tests_reaching(f.symbols.where("id % 20 = 0").select(F.col("id").alias("root")), f.edges, f.symbols, f.files, 3)


_LEVELS = """, ce AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 0), start AS (SELECT src AS id FROM ce GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
    lv0 AS (SELECT id AS node, 0 AS depth FROM start UNION SELECT e.dst, l.depth + 1 FROM lv0 l JOIN ce e ON e.src = l.node WHERE l.depth < 8), lv AS MATERIALIZED (SELECT node, min(depth) AS depth FROM lv0 GROUP BY node),
    goal AS (SELECT node, depth FROM lv ORDER BY depth DESC, node LIMIT 1),
    up AS MATERIALIZED (SELECT b.node, min(a.node) AS parent FROM lv b JOIN ce ON ce.dst = b.node JOIN lv a ON a.node = ce.src AND a.depth = b.depth - 1 GROUP BY b.node),
    back AS (SELECT node, depth AS step FROM goal UNION SELECT u.parent, b.step - 1 FROM back b JOIN up u ON u.node = b.node)"""


@query("path_hops", _LEVELS + " SELECT CAST(step AS INT) AS step, node FROM back")
def _(f: Facts) -> DataFrame:
    calls = f.edges.where("kind = 0")
    start = calls.select("src", "dst").distinct().groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]
    far = graph.distances(f.spark.createDataFrame([(start, start)], "root bigint, node bigint"), calls, 8).orderBy(F.desc("depth"), "node").first()
    return graph.call_path(f.edges, start, far["node"], 8)


# -- deployment ---------------------------------------------------------------------------------

_SEEDS = """, seeds AS MATERIALIZED (SELECT e.service, s.id AS node FROM entries e JOIN symbols s ON s.def_file_id = e.entry_file
    UNION SELECT e.service, o.symbol_id FROM entries e JOIN occ o ON o.file_id = e.entry_file WHERE o.role & 1 = 0
      AND NOT EXISTS (SELECT 1 FROM bodies b WHERE b.def_file_id = o.file_id AND o.line BETWEEN b.def_line AND b.def_end_line))"""
_REACH = (
    _SEEDS
    + """, steps AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind IN (0, 4)),
    reached AS (SELECT service, node AS symbol_id FROM seeds UNION SELECT r.service, e.dst FROM reached r JOIN steps e ON e.src = r.symbol_id)"""
)


def _reached(f: Facts) -> DataFrame:
    return deploy.reach(deploy.seeds(f.entries, f.symbols, f.occurrences), f.edges, 40)


@query("seed_union", _SEEDS + " SELECT service, node FROM seeds")
def _(f: Facts) -> DataFrame:
    return deploy.seeds(f.entries, f.symbols, f.occurrences)


@query("reach_closure", _REACH + " SELECT service, symbol_id FROM reached")
def _(f: Facts) -> DataFrame:
    return _reached(f)


@query("services_reaching", _REACH + " SELECT symbol_id, count(*) AS services FROM reached GROUP BY symbol_id")
def _(f: Facts) -> DataFrame:
    return _reached(f).groupBy("symbol_id").agg(F.count("*").alias("services"))


@query(
    "runs_attributed",
    _REACH
    + """, direct AS (SELECT DISTINCT r.symbol_id AS id, r.service FROM reached r JOIN symbols s ON s.id = r.symbol_id),
    bytype AS (SELECT DISTINCT o.id, d.service FROM owner o JOIN direct d ON d.id = o.type_id WHERE o.id NOT IN (SELECT id FROM direct)),
    ranked AS (SELECT def_file_id, id, row_number() OVER (PARTITION BY def_file_id ORDER BY ref_count DESC, id) AS rk FROM symbols WHERE def_file_id IS NOT NULL),
    hit AS (SELECT def_file_id, first(id ORDER BY rk) AS hit FROM ranked WHERE rk <= 40 AND id IN (SELECT id FROM direct) GROUP BY def_file_id)
    SELECT id, service, 'direct' AS via FROM direct UNION ALL SELECT id, service, 'type' FROM bytype
    UNION ALL SELECT DISTINCT s.id, d.service, 'file' FROM symbols s JOIN hit h ON h.def_file_id = s.def_file_id JOIN direct d ON d.id = h.hit
      WHERE s.id NOT IN (SELECT id FROM direct) AND s.id NOT IN (SELECT id FROM bytype)""",
)
def _(f: Facts) -> DataFrame:
    return deploy.runs(_reached(f), f.symbols)


def _deployed(f: Facts) -> tuple[DataFrame, DataFrame]:
    start = f.services.select("name", F.when(F.col("id") % 3 == 0, F.col("id")).alias("entry_file"), F.concat(F.lit("run "), F.col("name")).alias("command"))
    runs = f.services.where("id % 4 = 1").select(F.col("name").alias("service"), F.when(F.col("id") % 8 == 1, F.col("id")).alias("entry_file"), F.lit("job").alias("command"), F.lit("0 3 * * *").alias("schedule"))
    return start, runs


@query(
    "entrypoints_union",
    """SELECT name AS service, CASE WHEN id % 3 = 0 THEN id END AS entry_file, 'run ' || name AS command, NULL AS schedule FROM services
    UNION ALL SELECT name || ' (0 3 * * *)', CASE WHEN id % 8 = 1 THEN id END, 'job', '0 3 * * *' FROM services WHERE id % 4 = 1""",
)
def _(f: Facts) -> DataFrame:
    return deploy.entry_points(*_deployed(f))


@query("services_blind", "SELECT DISTINCT name FROM services WHERE id % 3 <> 0 AND name NOT IN (SELECT name FROM services WHERE id % 8 = 1)")
def _(f: Facts) -> DataFrame:
    return deploy.blind(*_deployed(f))


@query(
    "entry_file_by_path",
    """SELECT key, file_id FROM (SELECT n_nationkey AS key, f.id AS file_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY f.path <> h.hint, length(f.path), f.path) AS rn
    FROM (SELECT n_nationkey, r_name || '/' || n_name AS hint FROM nation JOIN region ON r_regionkey = n_regionkey) h JOIN files f ON starts_with(f.path, h.hint)) WHERE rn = 1""",
)
def _(f: Facts) -> DataFrame:
    hints = f.table("nation").join(f.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), F.concat_ws("/", "r_name", "n_name").alias("hint"))
    return deploy.entry_file(hints, f.files)


# -- services -----------------------------------------------------------------------------------


@query("cross_callers", "SELECT DISTINCT a.symbol_id, a.service_id, b.symbol_id AS caller_id FROM links a JOIN links b ON b.service_id = a.service_id AND b.role = 1 WHERE a.role = 0 AND a.symbol_id <> b.symbol_id")
def _(f: Facts) -> DataFrame:
    return services.cross_callers(f.links)


@query("handler_members", "SELECT DISTINCT l.service_id, l.symbol_id AS type_id, m.dst AS method_id FROM links l JOIN memb m ON m.src = l.symbol_id WHERE l.role = 0")
def _(f: Facts) -> DataFrame:
    return services.handler_members(f.links, f.symbols)


@query("rpc_callers", "SELECT * FROM wire")
def _(f: Facts) -> DataFrame:
    return services.rpc_callers(f.links, f.symbols, f.files, f.edges)


_TARGETS = """SELECT DISTINCT w.caller_id, w.service_id, w.rpc, m.dst AS method_id FROM wirecalls w JOIN links l ON l.service_id = w.service_id AND l.role = 0
    JOIN memb m ON m.src = l.symbol_id JOIN symbols h ON h.id = m.dst AND replace(lower(h.name), '_', '') = w.key JOIN files f ON f.id = h.def_file_id AND NOT f.generated
    JOIN symbols c ON c.id = w.caller_id WHERE c.id <> h.id AND c.def_file_id <> h.def_file_id"""


@query("rpc_targets", _TARGETS)
def _(f: Facts) -> DataFrame:
    return services.rpc_targets(f.links, f.symbols, f.files, f.edges)


@query(
    "rpc_targets_left",
    """, raw AS (SELECT mine.symbol_id, mine.service_id, hm.id AS method_id, replace(lower(hm.name), '_', '') AS hk, replace(lower(rpc.name), '_', '') AS rk, me.lang AS here, hm.lang AS there
      FROM links mine JOIN symbols me ON me.id = mine.symbol_id JOIN links theirs ON theirs.service_id = mine.service_id AND theirs.role = 0
      JOIN memb x ON x.src = theirs.symbol_id JOIN symbols hm ON hm.id = x.dst JOIN files hf ON hf.id = hm.def_file_id AND NOT hf.generated
      LEFT JOIN links client ON client.service_id = mine.service_id AND client.role = 1 AND client.via_symbol IS NOT NULL
      LEFT JOIN memb y ON y.src = client.via_symbol LEFT JOIN symbols rpc ON rpc.id = y.dst WHERE mine.role = 1),
    kept AS (SELECT symbol_id, service_id, method_id, any_value(here) AS here, any_value(there) AS there, bool_or(coalesce(rk = hk, false)) AS checked, bool_or(rk IS NULL) AS bare FROM raw GROUP BY ALL)
    SELECT symbol_id, service_id, method_id, checked FROM kept WHERE symbol_id <> method_id AND here <> there AND (checked OR bare)""",
)
def _(f: Facts) -> DataFrame:
    return services.rpc_targets_by_binding(f.links, f.symbols, f.files)


@query("services_called", "SELECT DISTINCT l.symbol_id, s.pkg || '.' || s.name AS service FROM links l JOIN services s ON s.id = l.service_id WHERE l.role = 1")
def _(f: Facts) -> DataFrame:
    return services.services_called(f.links, f.services)


@query("service_pivot", "SELECT s.id AS service_id, count(*) FILTER (l.role = 0) AS serves, count(*) FILTER (l.role = 1) AS calls FROM services s LEFT JOIN links l ON l.service_id = s.id GROUP BY s.id")
def _(f: Facts) -> DataFrame:
    return services.service_pivot(f.links, f.services)


@query(
    "rpc_callers_of_type",
    "SELECT DISTINCT l.symbol_id AS type_id, l.service_id, w.rpc, w.caller_id FROM links l JOIN memb m ON m.src = l.symbol_id JOIN symbols h ON h.id = m.dst JOIN wirecalls w ON w.service_id = l.service_id AND w.key = replace(lower(h.name), '_', '') WHERE l.role = 0",
)
def _(f: Facts) -> DataFrame:
    return services.rpc_callers_of_type(f.links, f.symbols, f.files, f.edges)


@query(
    "outgoing_services",
    _REACH
    + """ SELECT DISTINCT mine.symbol_id, s.pkg || '.' || s.name AS called, x.deployed FROM links mine JOIN services s ON s.id = mine.service_id
    LEFT JOIN (SELECT DISTINCT l.service_id, r.service AS deployed FROM links l JOIN symbols t ON t.id = l.symbol_id JOIN files f ON f.id = t.def_file_id AND NOT f.generated JOIN reached r ON r.symbol_id = t.id WHERE l.role = 0) x
      ON x.service_id = mine.service_id WHERE mine.role = 1""",
)
def _(f: Facts) -> DataFrame:
    return services.outgoing_services(f.links, f.services, f.symbols, f.files, _reached(f))


def _inward(n: int) -> str:
    """One hop: the closure over production callers, the calls that meet it, those not met before."""
    front = "SELECT id AS root, id AS node FROM symbols WHERE id % 20 = 0" if n == 1 else f"SELECT DISTINCT root, caller_id AS node FROM h{n - 1}"
    before = "" if n == 1 else " AND (c.root, w.caller_id) NOT IN (" + " UNION ALL ".join(f"SELECT root, caller_id FROM h{i}" for i in range(1, n)) + ")"
    return f""", n{n} AS (({front}) UNION SELECT c.root, e.src FROM n{n} c JOIN inward e ON e.dst = c.node),
    h{n} AS MATERIALIZED (SELECT DISTINCT c.root, {n} AS hop, w.method_id, w.service_id, w.rpc, w.caller_id FROM n{n} c JOIN wire w ON w.method_id = c.node WHERE true{before})"""


_HOPS = ", inward AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind = 0 AND src NOT IN (SELECT s.id FROM symbols s JOIN files f ON f.id = s.def_file_id WHERE f.is_test))" + _inward(1) + _inward(2)


@query("affects_hops", _HOPS + " SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def _(f: Facts) -> DataFrame:
    roots = f.symbols.where("id % 20 = 0").select(F.col("id").alias("root"))
    return services.affects_hops(roots, f.links, f.symbols, f.files, f.edges, depth=40, hops=2)


@query("affects_sites", _HOPS + " SELECT root, service_id, count(DISTINCT caller_id) AS sites, string_agg(DISTINCT rpc, ',' ORDER BY rpc) AS rpcs FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY root, service_id")
def _(f: Facts) -> DataFrame:
    roots = f.symbols.where("id % 20 = 0").select(F.col("id").alias("root"))
    hops = services.affects_hops(roots, f.links, f.symbols, f.files, f.edges, depth=40, hops=2)
    return hops.groupBy("root", "service_id").agg(F.count_distinct("caller_id").alias("sites"), F.array_join(F.array_sort(F.collect_set("rpc")), ",").alias("rpcs"))


@query(
    "affects_groups",
    _HOPS
    + """, fs AS (SELECT id, region AS service FROM (SELECT s.id, f.region FROM symbols s JOIN files f ON f.id = s.def_file_id) WHERE id % 3 > 0)
    SELECT h.root, h.hop, a.service AS "from", b.service AS "to", h.service_id, f.path, count(DISTINCT h.caller_id) AS sites, string_agg(DISTINCT h.rpc, ',' ORDER BY h.rpc) AS rpcs
    FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) h JOIN symbols c ON c.id = h.caller_id LEFT JOIN files f ON f.id = c.def_file_id LEFT JOIN fs a ON a.id = h.caller_id LEFT JOIN fs b ON b.id = h.method_id GROUP BY ALL""",
)
def _(f: Facts) -> DataFrame:
    roots = f.symbols.where("id % 20 = 0").select(F.col("id").alias("root"))
    hops = services.affects_hops(roots, f.links, f.symbols, f.files, f.edges, depth=40, hops=2)
    runs = f.symbols.where("id % 3 > 0").join(f.files.select(F.col("id").alias("def_file_id"), F.col("region").alias("service")), "def_file_id").select("id", "service")
    return services.hop_groups(hops, runs, f.symbols, f.files)


def _outward(n: int) -> str:
    front = "SELECT id AS root, id AS node, 0 AS d FROM symbols WHERE id % 20 = 0" if n == 1 else f"SELECT DISTINCT root, method_id AS node, 0 AS d FROM g{n - 1}"
    before = "" if n == 1 else " AND (c.root, t.method_id) NOT IN (" + " UNION ALL ".join(f"SELECT root, method_id FROM g{i}" for i in range(1, n)) + ")"
    return f""", w{n} AS (({front}) UNION SELECT c.root, e.dst, c.d + 1 FROM w{n} c JOIN outward e ON e.src = c.node WHERE c.d < 2),
    g{n} AS MATERIALIZED (SELECT DISTINCT c.root, {n} AS hop, t.caller_id, t.service_id, t.method_id FROM w{n} c JOIN targets t ON t.caller_id = c.node WHERE true{before})"""


@query(
    "rpc_chain",
    f", targets AS MATERIALIZED ({_TARGETS}), outward AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind = 0)" + "".join(_outward(n) for n in (1, 2, 3, 4)) + " SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4",
)
def _(f: Facts) -> DataFrame:
    return services.rpc_chain(f.symbols.where("id % 20 = 0").select(F.col("id").alias("root")), f.links, f.symbols, f.files, f.edges)


@query(
    "link_services",
    """, art AS (SELECT s.id AS via, split_part(f.path, '/', 2) AS pkg, replace(s.name, '#', '') || 'Service' AS service, CAST(s.id % 2 AS INT) AS role FROM symbols s JOIN files f ON f.id = s.def_file_id AND f.id % 3 = 0 WHERE s.kind = 1)
    SELECT a.pkg, a.service, b.id AS symbol_id, a.role, min(a.via) AS via_symbol
    FROM art a JOIN occ o ON o.symbol_id = a.via AND o.role & 1 = 0 AND o.file_id % 3 <> 0 JOIN bodies b ON b.def_file_id = o.file_id AND o.line BETWEEN b.def_line AND b.def_end_line GROUP BY a.pkg, a.service, b.id, a.role""",
)
def _(f: Facts) -> DataFrame:
    named = f.symbols.withColumn("name", F.when(F.col("kind") == 1, F.concat(F.regexp_replace("name", "[#]", ""), F.when(F.col("id") % 2 == 0, "ServiceServer").otherwise("ServiceClient"))).otherwise(F.col("name")))
    made = f.files.withColumn("generated", F.col("id") % 3 == 0)
    return services.link_services(named, made, f.occurrences, f.edges)


_STEMS = "(SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Register' || b || 'ServiceServer' WHEN 1 THEN 'New' || b || 'ServiceClient' WHEN 2 THEN lower(b) || 'ServiceStub' WHEN 3 THEN b || 'Service_GetClient' WHEN 4 THEN b || 'Client' ELSE 'Unimplemented' || b || 'ServiceBase' END AS name, b, p_partkey % 6 AS k FROM (SELECT p_partkey, replace(p_brand, '#', '') AS b FROM part))"


@query(
    "classify_names",
    f"SELECT id, name, CASE WHEN k = 4 THEN NULL ELSE b || 'Service' END AS service, CASE k WHEN 0 THEN 0 WHEN 5 THEN 0 WHEN 4 THEN NULL ELSE 1 END AS role FROM {_STEMS}",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    b, k = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("Register"), b, F.lit("ServiceServer")))
        .when(k == 1, F.concat(F.lit("New"), b, F.lit("ServiceClient")))
        .when(k == 2, F.concat(F.lower(b), F.lit("ServiceStub")))
        .when(k == 3, F.concat(b, F.lit("Service_GetClient")))
        .when(k == 4, F.concat(b, F.lit("Client")))
        .otherwise(F.concat(F.lit("Unimplemented"), b, F.lit("ServiceBase")))
    )
    rows = f.table("part").select(F.col("p_partkey").alias("id"), name.alias("name")).withColumn("said", X.classify(F.col("name")))
    return rows.select("id", "name", F.col("said.service").alias("service"), F.col("said.role").alias("role"))


@query("same_rpc", "SELECT c_custkey AS id, replace(lower(replace(c_name, '#', '_')), '_', '') AS key FROM customer", plain=True)
def _(f: Facts) -> DataFrame:
    return f.table("customer").select(F.col("c_custkey").alias("id"), X.same_rpc(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("key"))


# -- text ---------------------------------------------------------------------------------------


_NAMES = ", names AS (SELECT name, min(id) AS id FROM symbols WHERE kind IN (1, 3) AND length(name) >= 4 AND (strlen(name) >= 12 OR contains(name, '_') OR regexp_matches(substr(name, 2), '\\p{Lu}')) GROUP BY name HAVING count(*) <= 8)"


@query("weak_names", _NAMES + " SELECT name, id FROM names")
def _(f: Facts) -> DataFrame:
    return text.weak_names(f.symbols)


@query(
    "weak_links",
    _NAMES
    + """, hit AS (SELECT l.text, l.file_id, l.line, coalesce(a.id, b.id) AS dst FROM (SELECT DISTINCT * FROM lits) l LEFT JOIN names a ON a.name = l.text LEFT JOIN names b ON b.name = regexp_extract(l.text, '[^./:]*$') WHERE coalesce(a.id, b.id) IS NOT NULL AND strlen(l.text) >= 4)
    SELECT dst, file_id, line, 2 AS kind, 1 AS source, CAST(0.3 AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, text) AS rn FROM hit) WHERE rn <= 50""",
)
def _(f: Facts) -> DataFrame:
    return text.weak_links(f.literals, f.symbols)


@query("literals_search", "SELECT l.text, f.path, l.line FROM lits l JOIN files f ON f.id = l.file_id WHERE contains(lower(l.text), 'pkg.red')")
def _(f: Facts) -> DataFrame:
    return text.literal_search(f.literals.withColumn("enclosing", F.lit(None).cast("bigint")), f.files, "PKG.red").select("text", "path", "line")


@query(
    "literal_enclosing",
    """SELECT l.text, l.file_id, l.line, (SELECT first(b.id ORDER BY b.def_line DESC, b.id) FROM bodies b WHERE b.def_file_id = l.file_id AND l.line BETWEEN b.def_line AND b.def_end_line) AS enclosing
    FROM (SELECT DISTINCT * FROM lits) l WHERE strlen(text) >= 4 AND trim(text) <> '' AND NOT regexp_matches(text, '^[0-9.]+$')""",
)
def _(f: Facts) -> DataFrame:
    return text.admitted(f.literals, f.symbols)


def _heads(f: Facts) -> DataFrame:
    return f.table("events").select((F.col("event_id") % 200).alias("doc_id"), (1 + F.col("event_id") * 7 % 4).cast("int").alias("level"), F.col("event_type").alias("heading"), (2 * F.floor(F.col("event_id") / 200) + 1).cast("int").alias("start_line"))


@query("doc_sections", "SELECT doc_id, level, heading, start_line, end_line FROM sections")
def _(f: Facts) -> DataFrame:
    heads = _heads(f)
    return text.section_spans(heads, heads.groupBy("doc_id").agg((F.max("start_line") + 1).alias("lines")))


_TRAILS = """, before AS (SELECT *, max(start_line) FILTER (level <= 1) OVER w AS p1, max(start_line) FILTER (level <= 2) OVER w AS p2, max(start_line) FILTER (level <= 3) OVER w AS p3
      FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    trails AS MATERIALIZED (SELECT b.doc_id, b.level, b.heading, b.start_line, b.end_line, CAST(2 * (b.end_line - b.start_line) AS INT) AS words, concat_ws(' > ', CASE WHEN b.level > 1 THEN coalesce(h1.heading, '(unnamed)') END,
        CASE WHEN b.level > 2 THEN coalesce(h2.heading, '(unnamed)') END, CASE WHEN b.level > 3 THEN coalesce(h3.heading, '(unnamed)') END, b.heading) AS trail
      FROM before b LEFT JOIN heads h1 ON h1.doc_id = b.doc_id AND h1.start_line = b.p1 AND h1.level = 1 LEFT JOIN heads h2 ON h2.doc_id = b.doc_id AND h2.start_line = b.p2 AND h2.level = 2
      LEFT JOIN heads h3 ON h3.doc_id = b.doc_id AND h3.start_line = b.p3 AND h3.level = 3)"""


def _parsed(f: Facts) -> DataFrame:
    return markdown.flat(markdown.parse(f.markdown)).withColumn("doc_id", F.col("path").cast("bigint"))


@query("doc_trails", _TRAILS + " SELECT doc_id, level, heading, trail, start_line, end_line, words FROM trails")
def _(f: Facts) -> DataFrame:
    return _parsed(f).drop("path")


@query(
    "documents_overview",
    _TRAILS
    + """ SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS path, d.sections, d.words, t.top FROM (SELECT doc_id, count(*) AS sections, CAST(sum(words) AS BIGINT) AS words FROM trails GROUP BY doc_id) d
    LEFT JOIN (SELECT doc_id, string_agg(heading, ',' ORDER BY start_line) AS top FROM trails JOIN (SELECT doc_id, min(level) AS least FROM trails WHERE level > 1 GROUP BY doc_id) USING (doc_id) WHERE level = least GROUP BY doc_id) t USING (doc_id)""",
)
def _(f: Facts) -> DataFrame:
    rows = staged(_parsed(f), "sections")
    return text.documents(rows, rows.select("doc_id", "path").distinct()).withColumn("top", F.array_join("top", ","))


@query(
    "docs_about",
    _TRAILS
    + """, body AS (SELECT doc_id, start_line + k AS line, CASE k WHEN 0 THEN repeat('#', level) || ' ' ELSE 'about ' END || heading AS text FROM heads, (SELECT unnest([0, 1]) AS k)),
    hit AS (SELECT l.doc_id, l.line, max(t.start_line) AS start_line FROM body l JOIN trails t ON t.doc_id = l.doc_id AND l.line BETWEEN t.start_line AND t.end_line WHERE contains(l.text, 'click') GROUP BY ALL),
    counts AS (SELECT doc_id, start_line, count(*) AS hits FROM hit GROUP BY ALL)
    SELECT t.doc_id, t.start_line, t.heading, t.words, coalesce(c.hits, 0) AS hits, contains(t.trail, 'click') AS in_heading, CAST(CASE WHEN NOT contains(t.trail, 'click') THEN round(1000000 * c.hits / greatest(t.words, 1)) END AS BIGINT) AS density
    FROM trails t LEFT JOIN counts c USING (doc_id, start_line) WHERE contains(t.trail, 'click') OR c.hits IS NOT NULL""",
)
def _(f: Facts) -> DataFrame:
    lines = code.lines(f.markdown).select(F.col("path").cast("bigint").alias("doc_id"), (F.col("line") + 1).alias("line"), "text")
    rows = text.sections_about(lines, staged(_parsed(f), "sections"), "CLICK")
    return rows.select("doc_id", "start_line", "heading", "words", "hits", "in_heading", F.round(1000000 * F.col("density")).cast("bigint").alias("density"))


@query(
    "docs_rank",
    """SELECT d.doc_id, 0 AS start_line, d.source AS heading, CAST(d.n_chars AS INT) AS words, count(*) AS hits, contains(lower(d.source), 'idiot') AS in_heading
    FROM documents d JOIN doclines l ON l.doc_id = d.doc_id WHERE contains(lower(l.text), 'idiot') GROUP BY ALL""",
)
def _(f: Facts) -> DataFrame:
    sections = f.table("documents").select("doc_id", F.lit(0).alias("start_line"), F.lit(1 << 30).alias("end_line"), F.lit(1).alias("level"), F.col("source").alias("heading"), F.col("n_chars").cast("int").alias("words"))
    return text.section_hits(f.lines.select("doc_id", "line", "text"), sections, "IDIOT")


@query(
    "context_score",
    """, base AS (SELECT s.*, coalesce(f.is_test, false) AS t, (1 + least(s.ref_count, 50) / 100) * CASE WHEN f.generated THEN 0.05 ELSE 1.0 END * CASE s.kind WHEN 1 THEN 1.6 WHEN 3 THEN 1.4 WHEN 0 THEN 1.2 ELSE 0.35 END AS b,
      contains(lower(s.name), 'ring') AS nh, contains(lower(s.module), 'ring') AS mh FROM symbols s LEFT JOIN files f ON f.id = s.def_file_id WHERE s.def_file_id IS NOT NULL)
    SELECT id, CAST(round((4.0 * CASE WHEN lower(name) = 'ring' THEN 2.5 * b ELSE b END + CASE WHEN t AND nh THEN 0.9 ELSE 0 END) * 1000000) AS BIGINT) AS score, CASE WHEN t AND nh THEN 'name,test' ELSE 'name' END AS sources FROM base WHERE nh OR mh""",
)
def _(f: Facts) -> DataFrame:
    return text.context_scores(f.symbols, f.files, "Ring").select("id", F.round(F.col("score") * 1000000).cast("bigint").alias("score"), "sources")


# -- names and paths ----------------------------------------------------------------------------


@query(
    "symbol_strings",
    """SELECT p_partkey AS id, 'scip-go' AS scheme, 'pkg' || p_size AS package, CASE p_partkey % 4 WHEN 0 THEN 'meth' WHEN 1 THEN 'Type' WHEN 2 THEN 'odd name' ELSE 'arg' END || p_partkey AS name,
      CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 5 END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'mod/Type#' WHEN 1 THEN 'mod/' WHEN 2 THEN 'mod/Type#' ELSE 'mod/run().' END AS container, 'mod' AS module FROM part""",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    last = F.when(k == 0, F.concat(F.lit("Type#meth"), n, F.lit("()."))).when(k == 1, F.concat(F.lit("Type"), n, F.lit("#"))).when(k == 2, F.concat(F.lit("Type#`odd name"), n, F.lit("`."))).otherwise(F.concat(F.lit("run().(arg"), n, F.lit(")")))
    rows = f.table("part").select(F.col("p_partkey").alias("id"), parse_symbol(F.concat(F.lit("scip-go gomod pkg"), F.col("p_size").cast("string"), F.lit(" v1 mod/"), last)).alias("s"))
    return rows.select("id", "s.*")


@query(
    "path_forms",
    """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN r_name || '/' || s_name ELSE n_name END AS path
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    k, at = F.col("id") % 3, F.split("path", "/")
    given = F.when(k == 0, F.concat(F.lit("a/../../"), at[2])).when(k == 1, F.concat(at[0], F.lit("/./"), at[1], F.lit("//../"), at[2])).otherwise(F.concat(F.lit("./"), at[1], F.lit("/")))
    return f.files.select("id", X.normalise_path(given).alias("path"))


@query(
    "path_languages",
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 0 ELSE 3 END END AS lang,
      p_partkey % 4 = 0 AS is_test, p_partkey % 4 = 1 AS variant FROM part""",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Python", "go", "TSX", "", "kotlin"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("py", "pyi", "go", "tsx", "rs", "js"))), (F.col("p_size") % 6 + 1).cast("int"))
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    test = F.when(k == 0, F.element_at(F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in (("x/test_", ".py"), ("x/a", "_test.go"), ("x/tests/a", ".rs"), ("tests/a", ".rs"), ("x/a", ".spec.ts"))]), (F.floor(F.col("p_partkey") / 4) % 5 + 1).cast("int")))
    path = F.coalesce(test, F.concat(F.lit("x/contest_"), n, F.when(k == 1, F.lit(".ios.")).otherwise(F.lit(".")), ext))
    rows = f.table("part").select(F.col("p_partkey").alias("id"), said.alias("said"), F.concat(F.lit("x/a."), ext).alias("by_ext"), path.alias("path"))
    return rows.select("id", X.detect_lang(F.col("said"), F.col("by_ext")).alias("lang"), X.is_test_path(F.col("path")).alias("is_test"), X.is_build_variant(F.col("path")).alias("variant"))


@query(
    "occurrence_ranges",
    "SELECT l_orderkey AS line, CAST(l_linenumber AS INT) AS col_start, CAST(l_linenumber + 3 AS INT) AS col_end, count(*) AS n FROM lineitem GROUP BY ALL",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    line, start, end, k = F.col("l_orderkey").cast("int"), F.col("l_linenumber").cast("int"), (F.col("l_linenumber") + 3).cast("int"), F.col("l_partkey") % 4
    single = F.when(k == 0, F.struct(line.alias("line"), start.alias("start_character"), end.alias("end_character")))
    multi = F.when(k == 1, F.struct(line.alias("start_line"), start.alias("start_character"), (line + 2).alias("end_line"), end.alias("end_character")))
    packed = F.when(k == 2, F.array(line, start, end)).when(k == 3, F.array(line, start, line + 1, end)).otherwise(F.array().cast("array<int>"))
    return f.table("lineitem").select(X.occurrence_range(single, multi, packed).alias("r")).groupBy("r.line", "r.col_start", "r.col_end").agg(F.count("*").alias("n"))


# -- knowledge and change -----------------------------------------------------------------------


@query("ext_share", "SELECT p_type AS ext, count(*) AS files, count(*) / (SELECT count(*) FROM part) AS share, count(*) >= 5 AND count(*) / (SELECT count(*) FROM part) >= 0.05 AS kept FROM part GROUP BY p_type", plain=True)
def _(f: Facts) -> DataFrame:
    return knowledge.language_shares(f.table("part").select(F.col("p_type").alias("ext")))


@query(
    "lang_coverage",
    """, t AS (SELECT CASE lang WHEN 0 THEN 'rust' WHEN 1 THEN 'py' WHEN 2 THEN 'go' ELSE 'ts' END AS lang, count(*) AS files FROM files GROUP BY 1), i AS (SELECT CASE lang WHEN 0 THEN 'java' WHEN 1 THEN 'py' WHEN 2 THEN 'go' ELSE 'ts' END AS lang, count(*) AS symbols FROM symbols GROUP BY 1)
    SELECT lang, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(symbols, 0) AS BIGINT) AS symbols, CASE WHEN symbols IS NULL THEN 'NotIndexed' WHEN files IS NULL THEN 'IndexedOnly' ELSE 'Indexed' END AS state FROM t FULL JOIN i USING (lang)""",
)
def _(f: Facts) -> DataFrame:
    named = lambda zero: F.when(F.col("lang") == 0, zero).when(F.col("lang") == 1, "Python").when(F.col("lang") == 2, "golang").otherwise("tsx")
    tree = f.files.select(named("rust").alias("lang")).groupBy("lang").agg(F.count("*").alias("files"))
    index = f.symbols.select(named("java").alias("lang")).groupBy("lang").agg(F.count("*").alias("symbols"))
    return knowledge.language_coverage(tree, index)


@query(
    "snapshot_diff",
    """SELECT path, CASE WHEN id % 7 = 0 THEN 'created' WHEN id % 7 = 1 THEN 'removed' ELSE 'modified' END AS state FROM files WHERE id % 7 IN (0, 1, 2)""",
)
def _(f: Facts) -> DataFrame:
    before = f.files.where("id % 7 <> 0").select("path", "content_hash")
    after = f.files.where("id % 7 <> 1").select("path", F.when(F.col("id") % 7 == 2, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return knowledge.snapshot_diff(before, after)


@query(
    "overlay_diff",
    "SELECT module AS path, CAST(id AS VARCHAR) AS name, CASE id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'gone' ELSE 'moved' END AS state FROM symbols WHERE id % 5 IN (0, 1, 2)",
)
def _(f: Facts) -> DataFrame:
    rows = f.symbols.select(F.col("module").alias("path"), F.col("id").cast("string").alias("name"), "id")
    live = rows.where("id % 5 <> 1").select("path", "name", F.when(F.col("id") % 5 == 2, F.col("id") + 1).otherwise(F.col("id")).alias("line"))
    return knowledge.overlay_diff(live, rows.where("id % 5 <> 0").select("path", "name", F.col("id").alias("line")))


def _concept_links(f: Facts) -> DataFrame:
    return f.table("customer").select(F.col("c_custkey").alias("concept_id"), F.sha2((F.col("c_custkey") * 3).cast("string"), 256).alias("symbol_hash"))


@query("concept_resolution", "SELECT c_custkey AS concept_id, s.id AS symbol_id FROM customer LEFT JOIN symbols s ON s.hash = sha256(CAST(c_custkey * 3 AS VARCHAR))")
def _(f: Facts) -> DataFrame:
    return knowledge.resolve_links(_concept_links(f), f.symbols).select("concept_id", "symbol_id")


@query("concept_dangling", "SELECT c_custkey AS concept_id FROM customer WHERE sha256(CAST(c_custkey * 3 AS VARCHAR)) NOT IN (SELECT hash FROM symbols)")
def _(f: Facts) -> DataFrame:
    return knowledge.dangling(_concept_links(f), f.symbols).select("concept_id")


@query("latest_upsert", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1", plain=True)
def _(f: Facts) -> DataFrame:
    rows = f.table("events").select("user_id", "event_id", "event_type")
    return knowledge.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query(
    "verdict_standing",
    """SELECT CAST(n_nationkey AS VARCHAR) AS check_id, 'area' || n_regionkey AS area, CASE WHEN n_nationkey % 4 = 0 THEN 'Open' WHEN n_nationkey % 4 = 1 THEN 'Broken' WHEN n_nationkey % 4 = 2 THEN 'Current' ELSE 'Expired' END AS standing FROM nation""",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    n = f.table("nation")
    checks = n.select(F.col("n_nationkey").cast("string").alias("check_id"), F.concat(F.lit("area"), F.col("n_regionkey")).alias("area"))
    verdicts = n.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("string").alias("check_id"), (F.col("n_nationkey") % 4 != 1).alias("holds"), F.when(F.col("n_nationkey") % 4 == 2, "head").alias("commit_sha"))
    return knowledge.standings(checks, verdicts, "head")


@query(
    "verification_checks",
    """SELECT 'service-' || s.id AS check_id, 'cross-api' AS area, count(*) FILTER (l.role = 0) || ' symbols serve it, ' || count(*) FILTER (l.role = 1) || ' call it' AS claim
    FROM services s JOIN links l ON l.service_id = s.id GROUP BY s.id
    UNION ALL SELECT 'entry-' || replace(lower(name), '_', '-'), 'entrypoints', 'starts in file ' || id FROM services WHERE id % 3 = 0
    UNION ALL SELECT 'entry-' || replace(lower(name), '_', '-') || '-0-3', 'entrypoints', 'starts in file ' || id FROM services WHERE id % 8 = 1""",
)
def _(f: Facts) -> DataFrame:
    return knowledge.verification_checks(services.service_pivot(f.links, f.services), deploy.entry_points(*_deployed(f)))


@query(
    "coverage_areas",
    """, e AS (SELECT CASE WHEN id % 3 = 0 THEN id END AS f FROM services UNION ALL SELECT CASE WHEN id % 8 = 1 THEN id END FROM services WHERE id % 4 = 1),
    s AS (SELECT service_id, bool_or(role = 0) AND bool_or(role = 1) AS both_sides FROM links GROUP BY service_id),
    a AS (SELECT 'entrypoints' AS area, count(f) AS known, count(*) AS total FROM e UNION ALL SELECT 'cross-api', count(*) FILTER (both_sides), count(*) FROM s)
    SELECT area, known, total, CASE WHEN known = 0 THEN 'NotCovered' WHEN known < total THEN 'Partial' ELSE 'Indexed' END AS state FROM a""",
)
def _(f: Facts) -> DataFrame:
    return knowledge.coverage_areas(deploy.entry_points(*_deployed(f)), f.links, 1)


@query(
    "verdict_areas",
    """SELECT 'area' || n_regionkey AS area, CASE WHEN bool_or(n_nationkey % 4 = 1 AND n_regionkey <> 2) THEN 'Failing' WHEN n_regionkey = 3 THEN 'Partial' WHEN bool_and(n_nationkey % 4 = 2) THEN 'Verified'
      WHEN bool_or(n_nationkey % 4 = 3) THEN 'VerifyStale' ELSE 'Indexed' END AS state FROM nation WHERE n_regionkey <> 2 OR n_nationkey % 4 <> 1 GROUP BY n_regionkey""",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    n = f.table("nation").where("n_regionkey <> 2 or n_nationkey % 4 <> 1")
    area, k = F.concat(F.lit("area"), F.col("n_regionkey").cast("string")), F.col("n_nationkey") % 4
    standing = n.select(area.alias("area"), F.when(k == 0, "Open").when(k == 1, "Broken").when(k == 2, "Current").otherwise("Expired").alias("standing"))
    areas = n.select(area.alias("area"), F.when(F.col("n_regionkey") == 3, "Partial").otherwise("Indexed").alias("state")).distinct()
    return knowledge.apply_verdicts(areas, standing)


@query(
    "stale_links",
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN false ELSE s_suppkey % 4 <> 0 END AS needs_review FROM supplier",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    k = F.col("id") % 4
    links = f.files.select("id", F.when(k != 3, F.when(k == 2, F.concat(F.lit("gone/"), F.col("path"))).otherwise(F.col("path"))).alias("anchor_path"), F.when(k == 1, "other").otherwise(F.col("content_hash")).alias("anchor_hash"))
    return knowledge.flag_stale(links, f.files.select("path", "content_hash")).select("id", "needs_review")


@query("hit_classes", "SELECT CASE WHEN is_test THEN 'tests' WHEN generated THEN 'generated' ELSE 'hand-written' END AS class, count(*) AS hits FROM files GROUP BY 1")
def _(f: Facts) -> DataFrame:
    return knowledge.hit_classes(f.files)


@query("services_mentioning", "SELECT name FROM services WHERE contains(lower('run ' || name), 'nation_1')")
def _(f: Facts) -> DataFrame:
    return deploy.mentioning(f.services.select("name", F.concat(F.lit("run "), F.col("name")).alias("command"), F.array().cast("array<string>").alias("ports")), "NATION_1")


@query(
    "known_calls",
    """, t AS (SELECT id AS path, 0 AS line, 'x = ' || replace(name, '#', '') || '(1) + other()' AS text FROM symbols), n AS (SELECT DISTINCT replace(name, '#', '') AS name FROM symbols WHERE kind IN (1, 3) AND NOT def_generated)
    SELECT path, line, w AS name FROM (SELECT path, line, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS w FROM t) WHERE strlen(w) >= 5 AND w IN (SELECT name FROM n)""",
)
def _(f: Facts) -> DataFrame:
    own = f.symbols.withColumn("name", F.replace("name", F.lit("#"), F.lit("")))
    rows = own.select(F.col("id").alias("path"), F.lit(0).alias("line"), F.concat(F.lit("x = "), F.col("name"), F.lit("(1) + other()")).alias("text"))
    return search.known_calls(rows, own)


# -- change events ------------------------------------------------------------------------------


@query(
    "event_sessions",
    """, marked AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM marked)
    SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(min(ts)) AS start_us, count(*) AS events FROM numbered GROUP BY user_id, n""",
)
def _(f: Facts) -> DataFrame:
    events = f.table("events").select(F.col("user_id").cast("string").alias("path"), "ts")
    return dirty.bursts(events, "1 hour").select("path", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(start as timestamp_ntz))").alias("start_us"), "events")


@query(
    "dirty_state",
    """SELECT CAST(user_id AS VARCHAR) AS path, CASE last WHEN 'signup' THEN 'removed' ELSE 'modified' END AS state
    FROM (SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS last FROM events GROUP BY user_id) WHERE last <> 'view'""",
    plain=True,
)
def _(f: Facts) -> DataFrame:
    seen = F.when(F.col("event_type") != "signup", F.col("event_type"))
    events = f.table("events").select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id").alias("at"), seen.alias("content_hash"))
    baseline = events.select("path").distinct().withColumn("content_hash", F.lit("view"))
    return dirty.dirty_paths(events, baseline)


@query("rebased_paths", "SELECT path, CASE WHEN id % 7 = 0 THEN 'created' WHEN id % 7 = 1 THEN 'removed' ELSE 'modified' END AS state FROM files WHERE id % 7 IN (0, 1, 2)")
def _(f: Facts) -> DataFrame:
    k = F.col("id") % 7
    now = f.files.select("path", F.when(k == 2, "other").when(k != 1, F.col("content_hash")).alias("content_hash"))
    return dirty.rebased(now, f.files.where("id % 7 <> 0"))


@query("reindex_scheduler")
def _(f: Facts) -> DataFrame:
    from factloom.streaming import scheduler

    events = f.table("events").select(F.lit("repo").alias("key"), "ts", F.when(F.col("event_type") == "purchase", "head").otherwise("change").alias("op"), (F.col("event_id") % 120).cast("int").alias("debt"))
    return scheduler.decisions(events)

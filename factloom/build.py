"""From decoded documents and a source tree to the tables of a fact base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import scalar as X
from factloom.operators import deploy, edges, services, text
from factloom.sources import code, deployment, markdown, scip
from factloom.stage import staged


def build(spark: SparkSession, index: str, root: str, compose: tuple[str, ...] = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "docker-compose.override.yml"), pack: dict = rules.DEFAULT) -> dict[str, DataFrame]:
    """All tables of a repository at *root* whose index files lie under *index*."""
    files_here = staged(code.tree(spark, root, pack=pack), "tree")
    docs = staged(scip.read_index(spark, index), "documents")
    facts = scip.ingest(docs, scip.resolve_prefix(docs, files_here), code.generated(files_here))
    files = staged(facts["files"].join(files_here.select("path", "content_hash"), "path", "left"), "files")
    occ = staged(edges.dedupe_occurrences(facts["occurrences"]), "occurrences")
    symbols = staged(edges.finalize(facts["symbols"], occ, files), "symbols")
    implements = facts["implements"].select("src", "dst", "kind", "source", "confidence", F.lit(None).cast("bigint").alias("file_id"), F.lit(None).cast("bigint").alias("line"))
    relations = edges.all_edges(occ, symbols).unionByName(implements)

    own = files.where("not generated").select(F.col("id").alias("file_id"), "path")
    spelled = staged(code.literals(files_here.join(own, "path", "left_semi")).join(own, "path").select("text", "file_id", "line"), "literals")
    weak = text.weak_links(spelled, symbols)
    relations = staged(relations.unionByName(weak, allowMissingColumns=True), "edges")
    links = services.link_services(symbols, files, occ, relations)
    named = links.select("pkg", F.col("service").alias("name")).distinct().withColumn("id", X.stable_id(F.concat_ws(".", "pkg", "name")))
    links = staged(links.join(named.withColumnRenamed("name", "service"), ["pkg", "service"]).select(F.col("id").alias("service_id"), "symbol_id", "role", "via_symbol"), "links")

    prose = markdown.parse(files_here.where("path like '%.md'"))
    doc_files = prose.select(X.stable_id(F.col("path")).alias("id"), "path", "title", "lines")
    sections = markdown.flat(prose).join(doc_files.select("path", F.col("id").alias("doc_id")), "path").drop("path")

    texts = lambda rows: {r["path"]: r["text"] for r in rows.select("path", "text").collect()}
    small = texts(files_here.where(F.col("path").isin(*compose)))
    found = deployment.services([small[c] for c in compose if c in small])
    # Only what these files name comes to the driver: the images' recipes, scripts with a schedule, and the scripts that those run.
    small |= texts(files_here.where(F.col("path").isin(*{_recipe(s["build_context"]) for s in found})))
    scripts = files_here.where(F.col("path").endswith(".sh"))
    timed = texts(scripts.where(F.col("text").rlike(r"(?m)^\s*(?:[0-9*/,-]+\s+){5}\S")))
    called = {w.rsplit("/", 1)[-1] for t in timed.values() for w in t.split() if w.endswith(".sh")}
    small |= timed | texts(scripts.where(F.substring_index("path", "/", -1).isin(*called)))
    hints = []
    for s in found:
        target = deployment.resolve_command(s["command"] or "", pack)
        hints.append((s["name"], deployment.path_hint(target, s["build_context"], small.get(_recipe(s["build_context"]), ""))))
    runs = deployment.scheduled({p: t for p, t in small.items() if p.endswith(".sh")}, pack)
    contexts = {s["name"]: s["build_context"] for s in found}
    for r in runs:
        hints.append((f"{r['service']}\0{r['script']}", deployment.path_hint(deployment.resolve_command(r["command"], pack), contexts.get(r["service"]))))
    at = _entry_files(spark, hints, files)
    started = spark.createDataFrame(
        [(s["name"], s["command"], s["build_context"], s["image"], s["ports"], s["aliases"], at.get(s["name"])) for s in found],
        "name string, command string, build_context string, image string, ports array<string>, aliases array<string>, entry_file bigint",
    )
    on_demand = spark.createDataFrame(
        [(r["service"], r["schedule"], r["script"], r["command"], at.get(f"{r['service']}\0{r['script']}")) for r in runs], "service string, schedule string, script string, command string, entry_file bigint"
    )
    reach = deploy.reach(deploy.seeds(deploy.entry_points(started, on_demand), symbols, occ), relations)
    handles = edges.handles(symbols.select(F.col("id").alias("symbol_id"), X.handle_text(F.col("hash")).alias("code")))
    return {
        "files": files, "symbols": symbols, "occurrences": occ, "edges": relations, "proto_services": named, "service_links": links, "literals": text.admitted(spelled, symbols),
        "doc_files": doc_files, "doc_sections": sections, "deploy_services": started, "deploy_on_demand": on_demand, "deploy_reach": reach, "handles": handles,
    }


def _recipe(context: str | None) -> str:
    return f"{context or '.'}/Dockerfile".removeprefix("./")


def _entry_files(spark: SparkSession, hints: list[tuple[str, str | None]], files: DataFrame) -> dict[str, int]:
    """File of each hint; a management command is looked up by its file name, the shortest path winning."""
    plain = [(k, h) for k, h in hints if h and not h.startswith("*/")]
    out = {r["key"]: r["file_id"] for r in deploy.entry_file(spark.createDataFrame(plain, "key string, hint string"), files).collect()} if plain else {}
    for k, h in hints:
        if h and h.startswith("*/"):
            row = files.where(F.col("path").endswith(h[1:])).orderBy(F.length("path"), "path").select("id").first()
            if row:
                out[k] = row["id"]
    return out

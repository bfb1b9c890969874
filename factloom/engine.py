"""The questions that can be asked of a fact base, one method each.

Every method returns an :class:`Envelope`: a DataFrame of rows and the notes on what it cut,
cannot see, or has let go stale.  Subjects are handles or names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom import sinks
from factloom.authored import Authored
from factloom.envelope import Envelope
from factloom.functions import scalar as X
from factloom.operators import deploy, edges, graph, knowledge, search, services, survey, text
from factloom.stage import staged


class Ambiguous(Exception):
    """A subject that no symbol, or more than one, bears; holds the candidates."""


class Engine:
    """*dirty* names the paths that changed since the build, and is None where that is not tracked."""

    def __init__(self, spark: SparkSession, root: str, dirty: set[str] | None = None) -> None:
        self.spark, self.root, self.dirty = spark, root, dirty
        self.t = sinks.open_build(spark, root)
        self.authored = Authored(spark, root)

    def _fresh(self, out: Envelope, paths: DataFrame) -> Envelope:
        """Say which of the answer's *paths* (path) changed since the build; only changed ones are collected."""
        if self.dirty is None:
            return out.mark_stale(None, set())
        if not self.dirty:
            return out
        hit = paths.where(F.col("path").isin(*self.dirty)).select("path").distinct().collect()
        return out.mark_stale(self.dirty, {r["path"] for r in hit})

    # -- subjects ------------------------------------------------------------------------------

    def subject(self, given: str) -> int:
        """Id of a handle, or of the one symbol of this name."""
        if not given.strip():
            raise ValueError("an empty subject names nothing")
        row = self.t["handles"].where(F.col("handle") == given).first()
        if row:
            return row["symbol_id"]
        rows = search.symbols_named(self.t["symbols"], given).select("id", "name", "module").limit(21).collect()
        if len(rows) == 1:
            return rows[0]["id"]
        raise Ambiguous(rows)

    def _root(self, given: str) -> DataFrame:
        return self.spark.createDataFrame([(self.subject(given),)], "root bigint")

    def _named(self, rows: DataFrame, column: str) -> DataFrame:
        who = self.t["symbols"].select(F.col("id").alias(column), X.qualified(F.col("name"), F.col("container")).alias("name"), "def_file_id", "def_line")
        where = self.t["files"].select(F.col("id").alias("def_file_id"), "path")
        return rows.join(who, column).join(where, "def_file_id", "left").withColumn("at", X.location(F.col("path"), F.col("def_line"))).drop("def_file_id", "def_line", "path")

    # -- symbols -------------------------------------------------------------------------------

    def symbol(self, needle: str, limit: int = 15) -> Envelope:
        return Envelope(self._named(search.symbol_search(self.t["symbols"], needle, limit).select("id", "kind", "ref_count"), "id"))

    def refs(self, given: str, generated: bool = False) -> Envelope:
        me = self.subject(given)
        own = self.t["occurrences"].where(F.col("symbol_id") == me)
        out = Envelope(search.references(own, self.t["symbols"], self.t["files"], generated).orderBy("generated", "path", "line"))
        hidden = search.suppressed(own, self.t["files"]).first()
        if hidden and hidden["generated"] and not generated:
            out.suppressed.append(f"{hidden['generated']} references in generated code")
        row = self.t["symbols"].where(F.col("id") == me).select(X.is_under_resolved_attribute(F.col("kind"), F.col("container")).alias("loose")).first()
        if row and row["loose"]:
            out.unknown.append("an attribute of a type: indexers resolve few of its uses; search its name as text")
        at = out.rows.agg(F.min("path").alias("a"), F.max("path").alias("z"), F.count("*").alias("n")).first()
        if at["n"] > 1 and at["a"] == at["z"]:
            out.unknown.append(f"all {at['n']} references lie in {at['a']}")
        return self._fresh(out, out.rows)

    def usage(self, given: str, tests: bool = False) -> Envelope:
        own = self.t["occurrences"].where(F.col("symbol_id") == self.subject(given))
        rows = search.usage_by_file(own, self.t["files"])
        return Envelope((rows if tests else rows.where("not is_test")).orderBy("is_test", F.desc("uses"), "path"))

    def expand(self, given: str, source: DataFrame) -> Envelope:
        """Source lines of a symbol's body; *source* holds (path, line, text)."""
        me = self.t["symbols"].where(F.col("id") == self.subject(given))
        at = me.join(self.t["files"].select(F.col("id").alias("def_file_id"), "path"), "def_file_id")
        from factloom.sources import code

        return Envelope(code.excerpt(at.select("id", "path", F.col("def_line").alias("start"), F.coalesce("def_end_line", "def_line").alias("end")), source).orderBy("line"))

    def literal(self, needle: str) -> Envelope:
        return Envelope(search_literals(self.t, needle)).check_layer(self.t["literals"].limit(1).count(), "the literal layer", "build it from the source tree")

    def context(self, query: str, limit: int = 12) -> Envelope:
        scored = text.context_scores(self.t["symbols"], self.t["files"], query, self.authored.seeds(self.t["symbols"], query)).orderBy(F.desc("score"), "id").limit(limit)
        out = Envelope(self._named(scored, "id").orderBy(F.desc("score"), "id"))
        best = scored.first()
        if best is None or best["score"] < text.FLOOR:
            out.unknown.append("low confidence: nothing matches the query well")
        return out

    # -- walks ---------------------------------------------------------------------------------

    def graph(self, given: str, outward: bool = False, depth: int = 2, fanout: int = 8, exclude_tests: bool = False, kind: int = S.CALLS) -> Envelope:
        near = graph.neighbours(self.t["edges"], self.t["symbols"], self.t["files"], kind, outward, exclude_tests, fanout)
        nodes = graph.walk(self._root(given), near, depth)
        counts = graph.walk_counts(nodes, near, depth).first()
        out = Envelope(self._named(nodes, "node").orderBy("depth", "pos"))
        if counts["truncated"]:
            out.suppressed.append(f"{counts['truncated']} neighbours beyond the fan-out or already shown")
        return out

    def tests(self, given: str, depth: int = 3) -> Envelope:
        return Envelope(self._named(graph.tests_reaching(self._root(given), self.t["edges"], self.t["symbols"], self.t["files"], depth), "test_id"))

    def path(self, source: str, target: str, depth: int = 8) -> Envelope:
        hops = graph.call_path(self.t["edges"], self.subject(source), self.subject(target), depth)
        if hops is None:
            return Envelope(unknown=[f"no path within {depth} calls; dispatch at run time is not seen"], exit=S.NOT_FOUND)
        return Envelope(self._named(hops, "node").orderBy("step"))

    def weaklinks(self, given: str) -> Envelope:
        own = self.t["edges"].where(F.col("dst") == self.subject(given))
        out = Envelope(text.weak_sites(own, self.t["files"]).orderBy("is_test", "path", "line"))
        return out.check_layer(self.t["literals"].limit(1).count(), "the weak layer", "build it from the source tree")

    # -- subtrees ------------------------------------------------------------------------------

    def unreached(self, prefix: str = "") -> Envelope:
        rows = survey.unreached(self.t["symbols"], self.t["files"], self.t["edges"], self.t["occurrences"], self.t["service_links"], prefix)
        variant = X.is_build_variant(F.col("path"))
        out = Envelope(self._named(rows.where(~variant).drop("path"), "id").orderBy(F.desc("test_callers"), F.desc("ref_count"), "id"))
        if hidden := rows.where(variant).count():
            out.suppressed.append(f"{hidden} symbols that a build may select")
        return out

    def outline(self, prefix: str = "") -> Envelope:
        rows = survey.outline(self.t["symbols"], self.t["files"], self.t["edges"], self.t["service_links"], prefix)
        who = self.t["symbols"].select("id", X.qualified(F.col("name"), F.col("container")).alias("name"))
        rows = rows.join(who, "id").withColumn("at", X.location(F.col("path"), F.col("def_line")))
        out = Envelope(rows.select("path", "at", "name", "callers", "prod_callers", "dispatched", "def_line", "id").orderBy("path", "def_line", "id"))
        return self._fresh(out, out.rows)

    # -- deployment and services ---------------------------------------------------------------

    def _reached(self, out: Envelope) -> Envelope:
        return out.check_layer(self.t["deploy_reach"].limit(1).count(), "the deployment layer", "no entrypoint was resolved")

    def topology(self) -> Envelope:
        return Envelope(self.t["deploy_services"].orderBy("name"))

    def entrypoints(self, reaching: str | None = None) -> Envelope:
        rows = deploy.entry_points(self.t["deploy_services"], self.t["deploy_on_demand"])
        if reaching:
            at = self.t["deploy_reach"].where(F.col("symbol_id") == self.subject(reaching))
            rows = rows.join(at.select("service").distinct(), "service", "left_semi")
        return self._reached(Envelope(rows.orderBy("service", "command")))

    def runs(self, given: str) -> Envelope:
        out = self._reached(Envelope(deploy.runs(self.t["deploy_reach"], self.t["symbols"]).where(F.col("id") == self.subject(given)).select("service", "via").orderBy("service")))
        for row in deploy.blind(self.t["deploy_services"], self.t["deploy_on_demand"]).limit(20).collect():
            out.unknown.append(f"{row['name']} has no resolved entrypoint")
        return out

    def reaches(self, given: str, outgoing: bool = False) -> Envelope:
        me, t = self.subject(given), self.t
        if outgoing:
            rows = services.rpc_targets(t["service_links"], t["symbols"], t["files"], t["edges"]).where(F.col("caller_id") == me)
            return Envelope(self._named(rows, "method_id"))
        rows = services.rpc_callers(t["service_links"], t["symbols"], t["files"], t["edges"]).where(F.col("method_id") == me)
        return Envelope(self._named(rows, "caller_id"))

    def callers_of_type(self, given: str) -> Envelope:
        """Calls over the wire that name any method of a handler type."""
        t = self.t
        rows = services.rpc_callers_of_type(t["service_links"], t["symbols"], t["files"], t["edges"]).where(F.col("type_id") == self.subject(given))
        return Envelope(self._named(rows, "caller_id").orderBy("rpc", "caller_id"))

    def affects(self, given: str, depth: int = 12) -> Envelope:
        """Deployed services that a change touches: those that run the symbol, those that reach it over the wire hop by hop, and those that it calls.

        Rows are (kind, hop, from, to, service, path, sites, rpcs); *via* in-process says how a
        service was attributed.  The count of services adds those in process and the distinct
        callers, a service that is both counting twice.
        """
        t, root = self.t, self._root(given)
        run = staged(deploy.runs(t["deploy_reach"], t["symbols"]), "runs")
        own = run.join(root, F.col("id") == F.col("root")).select("service", "via").distinct()
        members = services.handler_members(t["service_links"], t["symbols"]).join(root, F.col("type_id") == F.col("root")).select("root", F.col("method_id").alias("node")).distinct()
        hops = services.affects_hops(root, t["service_links"], t["symbols"], t["files"], t["edges"], depth, start=members)
        grouped = staged(services.hop_groups(hops, run, t["symbols"], t["files"]), "groups")
        names = t["proto_services"].select(F.col("id").alias("service_id"), F.concat_ws(".", "pkg", "name").alias("service"))
        out_of = services.outgoing_services(t["service_links"], t["proto_services"], t["symbols"], t["files"], t["deploy_reach"]).join(root, F.col("symbol_id") == F.col("root"))
        none = lambda kind: F.lit(None).cast(kind)
        inside = own.select(F.lit("in process").alias("kind"), F.lit(0).alias("hop"), F.col("service").alias("from"), none("string").alias("to"), none("string").alias("service"), none("string").alias("path"), none("bigint").alias("sites"), F.col("via").alias("rpcs"))
        over = grouped.join(names, "service_id", "left").select(F.lit("over the wire").alias("kind"), "hop", "from", "to", "service", "path", "sites", "rpcs")
        outward = out_of.select(F.lit("calls").alias("kind"), F.lit(0).alias("hop"), none("string").alias("from"), F.col("deployed").alias("to"), F.col("called").alias("service"), none("string").alias("path"), none("bigint").alias("sites"), none("string").alias("rpcs"))
        out = self._reached(Envelope(inside.unionAll(over).unionAll(outward).orderBy("kind", "hop", "from", "service", "path", "to")))
        services_hit = own.count() + grouped.agg(F.count_distinct("from")).first()[0]
        if not services_hit:
            out.unknown.append("no deployed service reaches it; registration at run time is not seen")
        for row in deploy.blind(t["deploy_services"], t["deploy_on_demand"]).limit(20).collect():
            out.unknown.append(f"{row['name']} has no resolved entrypoint")
        return self._fresh(out, grouped)

    # -- documents, change, quality --------------------------------------------------------------

    def docs(self, query: str | None = None, lines: DataFrame | None = None) -> Envelope:
        """Documents, or the sections about *query*: by heading, and with *lines* (path, line from 1, text) of the tree by their bodies too."""
        names = self.t["doc_files"].select(F.col("id").alias("doc_id"), "path")
        if query is None:
            files = self.t["doc_files"].withColumnRenamed("id", "doc_id")
            return Envelope(text.documents(self.t["doc_sections"], files).orderBy("path"))
        own = (self.spark.createDataFrame([], "path string, line int, text string") if lines is None else lines).join(names, "path")
        rows = text.sections_about(own.select("doc_id", "line", "text"), self.t["doc_sections"], query).join(names, "doc_id")
        out = Envelope(rows.orderBy(*text.about_order()).select("path", "start_line", "end_line", "trail", "words", "hits", "in_heading"))
        if lines is None:
            out.unknown.append("bodies were not searched: name the repository")
        return self._fresh(out, rows)

    def line(self, path: str, number: int) -> Envelope:
        """The narrowest body and the narrowest section around a line, counted from 1."""
        f = self.t["files"].where(F.col("path") == path)
        body = f.select(F.col("id").alias("file_id"), F.lit(number - 1).cast("bigint").alias("line"))
        held = edges.inside(body, edges.spans(self.t["symbols"], "name")).orderBy(F.col("end") - F.col("start"), "encl").select(F.lit("symbol").alias("what"), "name", "start", "end").limit(1)
        sec = self.t["doc_sections"].join(self.t["doc_files"].where(F.col("path") == path).select(F.col("id").alias("doc_id")), "doc_id")
        sec = sec.where(F.lit(number).between(F.col("start_line"), F.col("end_line"))).orderBy(F.col("end_line") - F.col("start_line"))
        return Envelope(held.unionAll(sec.select(F.lit("section"), F.col("trail"), F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")).limit(1)))

    def for_find(self, needle: str, lines: DataFrame) -> Envelope:
        """Lines that hold *needle*; a subject that is no name is only searched as text."""
        out = Envelope(search.tree_search(lines, needle).orderBy("path", "line"))
        as_text = self.spark.range(1).select(X.looks_like_text(F.lit(needle)).alias("t")).first()["t"]
        if not as_text and not search.symbols_named(self.t["symbols"], needle).isEmpty():
            out.unknown.append("a symbol of this name exists: refs follows its uses")
        return self._fresh(out, out.rows)

    def for_change(self, given: str, lines: DataFrame) -> dict[str, Envelope]:
        """What to look at before a change: references, lines that name it and none accounts for, services, weak links."""
        me = self.subject(given)
        name = self.t["symbols"].where(F.col("id") == me).first()["name"]
        own = self.t["occurrences"].where(F.col("symbol_id") == me).join(self.t["files"].select(F.col("id").alias("file_id"), "path"), "file_id")
        left = search.residue(search.tree_search(lines, name, 0).select("path", "line"), own.select("path", "line"))
        return {"refs": self.refs(given), "residue": Envelope(left), "affects": self.affects(given), "weak": self.weaklinks(given)}

    def for_understand(self, given: str) -> dict[str, Envelope]:
        """How code works: its callees, the calls over the wire it leads to, and where it runs."""
        t = self.t
        chain = services.rpc_chain(self._root(given), t["service_links"], t["symbols"], t["files"], t["edges"])
        return {"calls": self.graph(given, outward=True, depth=1), "chain": Envelope(chain), "runs": self.runs(given)}

    def structure(self, prefix: str) -> Envelope:
        """What the files under a path define."""
        out = Envelope(survey.structure(self.t["symbols"], self.t["files"], prefix).orderBy("path", "def_line", "id"))
        if self.t["files"].where(search.under(prefix)).isEmpty():
            out.unknown.append(f"UNCHECKED: no file under {prefix} is in the index")
            out.exit = S.DEGRADED
        return self._fresh(out, out.rows)

    def layers(self, tree: DataFrame | None = None) -> Envelope:
        """Edges by kind and how they are known; with *tree* (path) the folders that the index does not hold at all."""
        out = Envelope(survey.layer_counts(self.t["edges"]).orderBy("kind", "source"))
        if tree is not None:
            out.unknown += [f"UNCHECKED: none of the {r['files']} files under {r['folder']} is in the index" for r in survey.unindexed(tree, self.t["files"]).orderBy("folder").limit(20).collect()]
        return out

    def candidates(self, limit: int = 40) -> Envelope:
        """Symbols whose change would touch most."""
        return Envelope(self._named(survey.change_candidates(self.t["symbols"], limit).select("id", "ref_count"), "id").orderBy(F.desc("ref_count"), "id"))

    def verify(self, now: DataFrame | None = None) -> Envelope:
        """Counts of the fact base; with *now* (path, content_hash) also which files have changed since."""
        out = Envelope(survey.verify_counts(self.t["files"], self.t["symbols"], self.t["occurrences"], self.t["edges"]))
        if now is not None:
            changed = knowledge.snapshot_diff(self.t["files"].where("content_hash is not null"), now.join(self.t["files"].select("path"), "path", "left_semi"))
            out.stale += [f"{r['state']}: {r['count']}" for r in changed.groupBy("state").count().orderBy("state").collect()]
        return out

    def standings(self, head: str | None = None) -> Envelope:
        """What can be confirmed about the fact base, and how its areas stand by the verdicts recorded so far."""
        t = self.t
        entries = deploy.entry_points(t["deploy_services"], t["deploy_on_demand"])
        checks = knowledge.verification_checks(services.service_pivot(t["service_links"], t["proto_services"]), entries)
        standing = knowledge.standings(checks.select("check_id", "area"), self.authored.verdicts(), head)
        areas = knowledge.apply_verdicts(knowledge.coverage_areas(entries, t["service_links"], t["proto_services"].count()), standing)
        out = Envelope(checks.join(standing.drop("area"), "check_id").select("area", "check_id", "claim", "standing").orderBy("area", "check_id"))
        out.unknown += [f"{r['area']}: {r['state']}" for r in areas.orderBy("area").collect()]
        if head is None:
            out.stale.append("no commit was named: verdicts count as expired")
        return out

    def unlinked_calls(self, given: str, source: DataFrame) -> Envelope:
        """Known types and callables, and RPCs, that a body names but no edge follows; *source* holds (path, line, text)."""
        body = self.expand(given, source).rows
        named = search.known_calls(body, self.t["symbols"])
        rpcs = services.rpc_mentions(body, self.t["service_links"], self.t["symbols"])
        followed = self.t["edges"].where((F.col("kind") == S.CALLS) & (F.col("src") == self.subject(given))).join(self.t["symbols"].select(F.col("id").alias("dst"), "name"), "dst").select("name").distinct()
        rows = named.join(followed, "name", "left_anti").select("path", "line", "name", F.lit("call").alias("what")).unionByName(rpcs.select("path", "line", F.col("rpc").alias("name"), F.lit("rpc").alias("what")))
        return Envelope(rows.orderBy("path", "line", "name", "what"))

    def coverage(self, tree: DataFrame) -> Envelope:
        """Languages of the tree (lang, files) against those indexed."""
        indexed = self.t["symbols"].groupBy("lang").agg(F.count("*").alias("symbols"))
        named = F.element_at(F.create_map(*[x for k, v in S.LANGS.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
        return Envelope(knowledge.language_coverage(tree, indexed.select(named.alias("lang"), "symbols")).orderBy("lang"))


def search_literals(tables: dict[str, DataFrame], needle: str) -> DataFrame:
    rows = text.literal_search(tables["literals"], tables["files"], needle)
    who = tables["symbols"].select(F.col("id").alias("enclosing"), F.col("name").alias("inside"))
    return rows.join(who, "enclosing", "left").drop("enclosing").orderBy(F.col("inside").isNull(), "path", "line")

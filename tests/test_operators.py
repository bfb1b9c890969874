"""Operators on tables small enough to read."""

from pyspark.sql import functions as F

from factloom.functions import scalar as X
from factloom.functions.symbols import parse
from factloom.operators import deploy, edges, graph, knowledge, search, services, survey, text

SYMBOL = "id bigint, name string, container_leaf string, container string, kind int, lang int, ref_count bigint, def_file_id bigint, def_line bigint, def_col_start int, def_generated boolean, def_end_line bigint, module string, doc string"


def symbols(spark, rows):
    return spark.createDataFrame([(i, n, leaf, None, k, i % 3, 0, f, a, 0, False, b, "m", None) for i, n, leaf, k, f, a, b in rows], SYMBOL)


def files(spark, rows):
    return spark.createDataFrame(rows, "id bigint, path string, generated boolean, is_test boolean")


def occurrences(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, symbol_id bigint, line bigint, col_start int, role int, enc_end bigint")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def calls(spark, pairs):
    return spark.createDataFrame([(a, b, 0, 0, 1.0, 1, 5) for a, b in pairs], "src bigint, dst bigint, kind int, source int, confidence double, file_id bigint, line bigint")


def test_innermost_body_calls(spark):
    s = symbols(spark, [(1, "C", "", 1, 1, 0, 1000), (2, "m", "C", 3, 1, 10, 700), (3, "inner", "m", 3, 1, 20, 30), (4, "f", "", 3, 2, 0, 5)])
    o = occurrences(spark, [(1, 4, 25, 0, 0, None), (1, 4, 600, 0, 8, None), (1, 4, 900, 0, 0, None), (1, 4, 26, 0, 2, None), (1, 4, 27, 0, 1, None)])
    assert rows(edges.call_edges(o, s), "src", "dst", "line") == [(1, 4, 900), (2, 4, 600), (3, 4, 25)]


def test_binder_only_outside_bodies(spark):
    s = symbols(spark, [(1, "x", "", 2, 1, 3, None), (2, "f", "", 3, 2, 0, 9), (3, "g", "", 3, 1, 10, 20), (4, "y", "", 2, 1, 12, None)])
    o = occurrences(spark, [(1, 2, 3, 4, 0, None), (1, 2, 12, 4, 0, None)])
    assert rows(edges.binder_edges(o, s), "src", "dst") == [(1, 2)]


def test_duplicate_occurrence_keeps_its_end(spark):
    o = occurrences(spark, [(1, 1, 2, 0, 1, None), (1, 1, 2, 0, 1, 9)])
    assert rows(edges.dedupe_occurrences(o), "symbol_id", "enc_end") == [(1, 9)]


def test_hand_written_definition_wins(spark):
    f = files(spark, [(1, "a/gen.go", True, False), (2, "a/own.go", False, False)])
    o = occurrences(spark, [(1, 1, 2, 0, 1, 4), (2, 1, 7, 0, 1, None)])
    assert rows(edges.definition_pick(o, f), "symbol_id", "def_file_id", "def_end_line") == [(1, 2, None)]


def test_names(spark):
    s = symbols(spark, [(1, "Order", "", 1, 1, 0, 9), (2, "OrderService", "", 1, 1, 20, 30), (3, "Order", "", 1, 2, 0, 9), (4, "other", "", 3, 2, 0, 1)])
    assert search.symbol_search(s, "order", 10).count() == 3
    assert [r["id"] for r in search.symbol_search(s, "Order", 10).collect()] == [1, 3, 2]
    assert search.symbols_named(s, "Order").count() == 2
    assert search.symbol_search(s, "Ord%ice", 10).count() == 1


def test_walk_cycle_and_fanout(spark):
    s = symbols(spark, [(i, f"s{i}", "", 3, 1, i, i) for i in range(1, 8)])
    f = files(spark, [(1, "a.py", False, False)])
    e = calls(spark, [(1, 2), (2, 3), (3, 1), (1, 4), (1, 5), (1, 6), (1, 7)])
    near = graph.neighbours(e, s, f, outward=True, fanout=2)
    root = spark.createDataFrame([(1,)], "root bigint")
    nodes = graph.walk(root, near, 5)
    assert rows(nodes, "node", "depth", "parent") == [(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 1, 1)]
    counts = graph.walk_counts(nodes, near, 5).first()
    assert (counts["nodes"], counts["revisited"], counts["truncated"]) == (4, 1, 4)


def test_paths(spark):
    e = calls(spark, [(1, 2), (2, 4), (1, 3), (3, 4), (4, 5)])
    assert rows(graph.call_path(e, 1, 5), "step", "node") == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert graph.call_path(e, 5, 1) is None
    assert rows(graph.call_path(e, 2, 2), "step", "node") == [(0, 2)]


def test_tests_reaching_stops_at_tests(spark):
    s = symbols(spark, [(1, "a", "", 3, 1, 0, 1), (2, "b", "", 3, 1, 5, 6), (3, "t", "", 3, 2, 0, 1), (4, "u", "", 3, 2, 5, 6)])
    f = files(spark, [(1, "a.py", False, False), (2, "tests/t.py", False, True)])
    got = graph.tests_reaching(spark.createDataFrame([(1,)], "root bigint"), calls(spark, [(2, 1), (3, 2), (4, 3)]), s, f, 5)
    assert rows(got, "test_id", "depth") == [(3, 2)]


def test_handles_are_short_free_prefixes(spark):
    h = spark.createDataFrame([(1, "abcdef"), (2, "abxyzz"), (3, "acdefg"), (4, "abcdzz")], "symbol_id bigint, code string")
    assert rows(edges.handles(h, 6), "symbol_id", "handle") == [(1, "ab"), (2, "abx"), (3, "ac"), (4, "abc")]
    code = spark.range(1).select(X.handle_text(F.lit("ff00" * 8)).alias("c")).first()["c"]
    assert code[:3] == X.ALPHABET[31] + X.ALPHABET[0b11100] + X.ALPHABET[0]


def test_unreached_and_outline(spark):
    s = symbols(spark, [(1, "H", "", 1, 1, 0, 50), (2, "Rpc", "H", 3, 1, 5, 9), (3, "dead", "", 3, 1, 60, 70), (4, "live", "", 3, 1, 80, 90), (5, "__init__", "", 3, 1, 95, 96), (6, "t", "", 3, 2, 0, 5)])
    f = files(spark, [(1, "src/a.py", False, False), (2, "tests/a.py", False, True)])
    e = calls(spark, [(6, 3), (3, 4)])
    links = spark.createDataFrame([(1, 1, 0, None)], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    o = occurrences(spark, [(1, 3, 62, 0, 0, None)])
    assert rows(survey.unreached(s, f, e, o, links, "src/"), "id", "test_callers", "prod_refs") == [(3, 1, 1)]
    assert (2, 0, True) in rows(survey.outline(s, f, e, links), "id", "callers", "dispatched")


def test_service_names(spark):
    names = ["NewChatServiceClient", "chatServiceClient", "ChatService_StreamRepliesClient", "DatabaseClient", "RegisterChatServiceServer", "UnimplementedChatServiceServer", "ChatServiceBase", "x"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.classify(F.col("n")).alias("c")).collect()
    said = {r["n"]: tuple(r["c"]) if r["c"] else None for r in got}
    assert {said[n] for n in names[:3]} == {("ChatService", 1)}
    assert said["DatabaseClient"] is None and said["x"] is None
    assert {said[n] for n in names[4:7]} == {("ChatService", 0)}


def test_rpc_over_the_wire(spark):
    s = symbols(
        spark,
        [(1, "ChatServiceClient", "", 1, 1, 0, 20), (2, "SendReply", "ChatServiceClient", 3, 1, 5, 5), (3, "Handler", "", 1, 2, 0, 40), (4, "send_reply", "Handler", 3, 2, 5, 9), (5, "helper", "Handler", 3, 2, 10, 12), (6, "use", "", 3, 3, 0, 9)],
    )
    f = files(spark, [(1, "gen/chat/c.go", True, False), (2, "srv/h.py", False, False), (3, "app/u.py", False, False)])
    links = spark.createDataFrame([(1, 3, 0, 9), (1, 6, 1, 1)], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    e = calls(spark, [(6, 2)])
    assert rows(services.rpc_callers(links, s, f, e), "method_id", "caller_id") == [(4, 6)]
    assert rows(services.rpc_targets(links, s, f, e), "caller_id", "method_id") == [(6, 4)]
    assert rows(services.rpc_targets_by_binding(links, s, f), "method_id", "checked") == [(4, True)]
    hops = services.affects_hops(spark.createDataFrame([(4,)], "root bigint"), links, s, f, e)
    assert rows(hops, "hop", "caller_id") == [(1, 6)]
    chain = services.rpc_chain(spark.createDataFrame([(6,)], "root bigint"), links, s, f, e)
    assert rows(chain, "hop", "method_id") == [(1, 4)]


def test_weak_links_and_literals(spark):
    s = symbols(spark, [(1, "handle_frost", "", 3, 1, 0, 9), (2, "Order", "", 1, 1, 20, 30)])
    lits = spark.createDataFrame([("dispatch.handle_frost", 1, 5), ("Order", 1, 6), ("1.2.3", 1, 7), ("handle_frost", 1, 25)], "text string, file_id bigint, line bigint")
    assert rows(text.weak_links(lits, s), "dst", "line") == [(1, 5), (1, 25)]
    assert rows(text.admitted(lits, s), "text", "enclosing") == [("Order", 1), ("dispatch.handle_frost", 1), ("handle_frost", 2)]


def test_runs_fall_back_to_type_and_file(spark):
    s = symbols(spark, [(1, "T", "", 1, 1, 0, 50), (2, "m", "T", 3, 1, 5, 9), (3, "free", "", 3, 1, 60, 70), (4, "far", "", 3, 2, 0, 9)])
    reached = spark.createDataFrame([("api", 1)], "service string, symbol_id bigint")
    assert rows(deploy.runs(reached, s), "id", "via") == [(1, "direct"), (2, "type"), (3, "file")]


def test_budget_admits_the_first_row(spark):
    r = spark.createDataFrame([(1, 100), (2, 10)], "id int, chars int")
    assert rows(search.within_budget(r, [F.asc("id")], "chars", 5), "id") == [(1,)]
    assert rows(search.within_budget(r, [F.desc("id")], "chars", 31), "id") == [(1,), (2,)]


def test_knowledge(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "key string, version int, note string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 5, "w")], "key string, version int, note string")
    assert rows(knowledge.upsert(old, new, ["key"], "version"), "key", "note") == [("a", "z"), ("b", "y"), ("c", "w")]
    areas = spark.createDataFrame([("a", "Indexed"), ("b", "Indexed"), ("c", "NotIndexed"), ("d", "Indexed")], "area string, state string")
    said = spark.createDataFrame([("1", "a", "Broken"), ("2", "a", "Current"), ("3", "b", "Current"), ("4", "c", "Current"), ("5", "d", "Expired")], "check_id string, area string, standing string")
    assert rows(knowledge.apply_verdicts(areas, said), "area", "state") == [("a", "Failing"), ("b", "Verified"), ("c", "NotIndexed"), ("d", "VerifyStale")]
    links = spark.createDataFrame([("p", "1"), ("q", "1"), (None, None)], "anchor_path string, anchor_hash string")
    hashes = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, content_hash string")
    assert rows(knowledge.flag_stale(links, hashes).where("anchor_path is not null"), "anchor_path", "needs_review") == [("p", False), ("q", True)]


def test_scalars(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(X.normalise_path(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert one(X.normalise_path(F.lit("a/../../b"))) is None
    assert one(X.package_of(F.lit("gen/chat/c.go"))) == "chat" and one(X.package_of(F.lit("c.go"))) is None and one(X.package_of(F.lit("a/v1.2/c.go"))) is None
    assert one(X.container_leaf(F.lit("m/pkg/Service#"))) == "Service"
    assert one(X.qualified(F.lit("m"), F.lit("pkg/Service#"))) == "Service.m"
    assert one(X.slug(F.lit("  Hello, World! v1.2 "))) == "hello-world-v1.2"
    assert one(X.clean_doc(F.array(F.lit("```py\ndef f()\n```\n Does it. "), F.lit("More")))) == "Does it. More"
    assert one(X.is_test_path(F.lit("a/test_x.py"))) and one(X.is_test_path(F.lit("tests/x.go"))) and not one(X.is_test_path(F.lit("a/latest.py")))
    assert one(X.is_distinctive(F.lit("getUser"))) and not one(X.is_distinctive(F.lit("Order")))


def test_symbol_strings():
    p = parse("scip-python python shop 1.0 `shop.orders`/Order#total().")
    assert (p.name, p.kind, p.container, p.module, p.package) == ("total", 3, "`shop.orders`/Order#", "shop.orders", "shop")
    assert parse("scip-go gomod x v1 `a/b`/Store#").kind == 1
    assert parse("scip-go gomod x v1 `a/b`/limit.").kind == 2
    assert parse("scip-go gomod x v1 `a/b`/f().(arg)")[2:4] == ("arg", 5)
    assert parse("local 12").kind == 7
    assert parse("too few") is None


def test_rpc_mentions(spark):
    s = symbols(spark, [(1, "ChatServiceClient", "", 1, 1, 0, 20), (2, "SendReply", "ChatServiceClient", 3, 1, 5, 5)])
    links = spark.createDataFrame([(1, 6, 1, 1)], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    lines = spark.createDataFrame([("a", 1, "c.Other(x).SendReply(y)"), ("a", 2, "SendReply(y)"), ("b", 1, "c.sendReply(")], "path string, line int, text string")
    assert rows(services.rpc_mentions(lines, links, s), "path", "line", "rpc") == [("a", 1, "SendReply")]


def test_empty_tables(spark):
    s, f, o = symbols(spark, []), files(spark, []), occurrences(spark, [])
    e = edges.all_edges(o, s)
    links = spark.createDataFrame([], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    assert e.count() == 0 and survey.unreached(s, f, e, o, links).count() == 0
    roots = spark.createDataFrame([(1,)], "root bigint")
    assert services.affects_hops(roots, links, s, f, e).count() == 0
    assert graph.distances(roots.select("root", F.col("root").alias("node")), e, 3).count() == 1


def test_sections_end_without_pairing(spark):
    import random

    rnd = random.Random(4)
    heads = [(d, rnd.randint(1, 6), f"h{i}", line) for d in range(4) for i, line in enumerate(sorted(rnd.sample(range(900), 120)))]
    table = spark.createDataFrame(heads, "doc_id bigint, level int, heading string, start_line int")
    lines = spark.createDataFrame([(d, 900) for d in range(4)], "doc_id bigint, lines int")
    want = sorted((d, v, h, at, min((b[3] for b in heads if b[0] == d and b[3] > at and b[1] <= v), default=901) - 1) for d, v, h, at in heads)
    found = text.section_spans(table, lines)
    assert rows(found, "doc_id", "level", "heading", "start_line", "end_line") == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # only with the documents, no headings with headings


def test_scheduler_query_reads_every_event(spark):
    from factloom.plans import registry

    data = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{data}/events.parquet").count()
    assert events > 500 and registry.queries()["reindex_scheduler"](spark, data).count() == events


def test_callers_of_few_services_in_many_tasks(spark, monkeypatch):
    from factloom import stage

    links = spark.createDataFrame([(i % 2, i, 0 if i % 3 else 1, None) for i in range(60) for _ in range(2)], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    want = sorted((a, a % 2, b) for a in range(60) for b in range(60) if a % 3 and not b % 3 and a % 2 == b % 2)
    found = services.cross_callers(links)
    assert rows(found, "symbol_id", "service_id", "caller_id") == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are not dealt again
    assert len({r[0] for r in found.select(F.spark_partition_id()).distinct().collect()}) > 2  # more tasks than services
    monkeypatch.setattr(stage, "BROADCAST_ROWS", 0)
    assert rows(services.cross_callers(links), "symbol_id", "service_id", "caller_id") == want


def test_targets_by_binding_in_many_tasks(spark, monkeypatch):
    from factloom import stage

    s = symbols(spark, [(1, "H", "", 1, 1, 0, 50), *((i, f"m{i}", "H", 3, 1, i, i) for i in range(2, 20)), *((i, f"u{i}", "", 3, 2, i, i) for i in range(20, 60))])
    f = files(spark, [(1, "a.py", False, False), (2, "b.py", False, False)])
    links = spark.createDataFrame([(1, 1, 0, None), *((1, i, 1, None) for i in range(20, 60))], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    want = sorted((u, 1, m, False) for u in range(20, 60) for m in range(2, 20) if u % 3 != m % 3)
    found = services.rpc_targets_by_binding(links, s, f)
    assert rows(found, "symbol_id", "service_id", "method_id", "checked") == want
    assert len({r[0] for r in found.select(F.spark_partition_id()).distinct().collect()}) > 1  # one service, several tasks
    monkeypatch.setattr(stage, "BROADCAST_ROWS", 0)
    assert rows(services.rpc_targets_by_binding(links, s, f), "symbol_id", "service_id", "method_id", "checked") == want


def test_large_sides_are_not_dealt_again(spark, monkeypatch):
    s = symbols(spark, [(i, f"s{i % 3}", "", 3, 1, i, i) for i in range(1, 30)])
    f = files(spark, [(1, "a.py", False, False)])
    o = occurrences(spark, [(1, i, i, 0, 1, None) for i in range(1, 30)])
    links = spark.createDataFrame([(1, 1, 0, None)], "service_id bigint, symbol_id bigint, role int, via_symbol bigint")
    e = calls(spark, [(1, 2)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in edges.definition_pick(o, f)._jdf.queryExecution().executedPlan().toString()  # definitions stay where they are
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert not plan(services.rpc_callers(links, s, f, e)).startswith("Aggregate")  # pairs are distinct as they meet
    assert plan(edges.binder_edges(o, s)).count("Aggregate") == 3  # held lines twice, bindings once; no distinct over all references
    near = graph.neighbours(e, s, f, paths=False)
    assert "path" not in near.columns and plan(near).count("Join") == 1  # edges meet symbols, no files
    apart = spark.createDataFrame([(1, i, 0, 0, 1.0, None, 5) for i in range(2, 30)], e.schema)
    assert rows(graph.neighbours(apart, s, f, outward=True), "other", "path") == [(i, None) for i in range(2, 30)]
    assert "xxhash64" in plan(graph.neighbours(apart, s, f))  # sites without a file are no one task


def test_distances_by_small_and_large_levels(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(12)] + [(3, 1), (5, 20), (20, 6), (0, 7)]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    start = spark.createDataFrame([(0, 0), (4, 4)], "root bigint, node bigint")
    want = []
    for root in (0, 4):
        depth, level = {root: 0}, [root]
        while level:
            level = sorted({b for a, b in pairs if a in level} - set(depth))
            depth |= {n: max(depth.values()) + 1 for n in level} if level else {}
        want += [(root, n, d) for n, d in depth.items()]
    for most in (500_000, 2, 0):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
        assert rows(graph.distances(start, e, 40), "root", "node", "depth") == sorted(want)

"""Service boundaries: who serves and who calls which service, and what a change reaches over the wire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import scalar as X
from factloom.operators.edges import enclosing_type, inside, members, ranked, spans
from factloom.operators.graph import distances
from factloom.stage import paired, staged


def artefacts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, pkg, service, role) of generated symbols whose names follow a service convention."""
    made = files.where("generated").select(F.col("id").alias("def_file_id"), X.package_of(F.col("path")).alias("folder"))
    # Through a generator the rules are evaluated once a row, however often their result is used.
    rows = symbols.join(made, "def_file_id").select("*", F.explode(F.array(X.classify(F.col("name")))).alias("said"))
    return rows.where("said is not null and folder is not null").select(F.col("id").alias("symbol_id"), F.col("folder").alias("pkg"), F.col("said.service").alias("service"), F.col("said.role").alias("role"), "name")


def link_services(symbols: DataFrame, files: DataFrame, occ: DataFrame, edges: DataFrame) -> DataFrame:
    """(pkg, service, symbol_id, role, via_symbol): users of an artefact, and implementors and embedders of a server's."""
    art = artefacts(symbols, files).withColumnRenamed("symbol_id", "via")
    own = files.where("not generated").select(F.col("id").alias("file_id"))
    refs = occ.where(F.col("role").bitwiseAND(1) == 0).select(F.col("symbol_id").alias("via"), "file_id", "line").join(own, "file_id", "left_semi").join(art.select("via"), "via", "left_semi")
    users = inside(refs.distinct(), spans(symbols)).select("via", F.col("encl").alias("symbol_id"))
    serving = art.where(F.col("role") == S.SERVES).select("via", "name")
    implementors = edges.where(F.col("kind") == S.IMPLEMENTS).select(F.col("dst").alias("via"), F.col("src").alias("symbol_id")).join(serving.select("via"), "via", "left_semi")
    # A field named as the artefact, whose line refers to it: the type around the field embeds the server.
    field = symbols.select(F.col("id").alias("field"), "name", F.col("def_file_id").alias("file_id"), F.col("def_line").alias("line"))
    embeds = serving.join(field, "name").where("field <> via").join(refs.withColumnRenamed("via", "used"), ["file_id", "line"]).where("used = via")
    embedders = embeds.join(members(symbols).select("type_id", F.col("member_id").alias("field")), "field").select("via", F.col("type_id").alias("symbol_id"))
    links = users.unionAll(implementors).unionAll(embedders).join(art.select("via", "pkg", "service", "role"), "via")
    return links.groupBy("pkg", "service", "symbol_id", "role").agg(F.min("via").alias("via_symbol"))


def cross_callers(links: DataFrame) -> DataFrame:
    """(symbol_id, service_id, caller_id): for what serves a service, all that call it.

    Both sides are distinct before they meet, so no pair comes twice.
    """
    served = links.where(F.col("role") == S.SERVES).select("symbol_id", "service_id").distinct()
    calls = links.where(F.col("role") == S.CALLS_SERVICE).select(F.col("symbol_id").alias("caller_id"), "service_id").distinct()
    return paired(served, calls, ["service_id"]).where("caller_id <> symbol_id").select("symbol_id", "service_id", "caller_id")


def handler_members(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(service_id, type_id, method_id): members of the types that serve a service."""
    served = links.where(F.col("role") == S.SERVES).select("service_id", F.col("symbol_id").alias("type_id")).distinct()
    return served.join(members(symbols), "type_id").select("service_id", "type_id", F.col("member_id").alias("method_id")).distinct()


def client_calls(links: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(service_id, rpc, caller_id): hand-written calls of the members of a service's client artefact."""
    via = links.where((F.col("role") == S.CALLS_SERVICE) & F.col("via_symbol").isNotNull()).select("service_id", F.col("via_symbol").alias("type_id")).distinct()
    names = symbols.select(F.col("id").alias("member_id"), F.col("name").alias("rpc"))
    rpcs = via.join(members(symbols).select("type_id", "member_id"), "type_id").join(names, "member_id").select("service_id", "member_id", "rpc").distinct()
    own = files.where("not generated").select(F.col("id").alias("def_file_id"))
    caller = symbols.join(own, "def_file_id", "left_semi").select(F.col("id").alias("caller_id"))
    calls = edges.where(F.col("kind") == S.CALLS).select(F.col("src").alias("caller_id"), F.col("dst").alias("member_id")).distinct()
    return rpcs.join(calls, "member_id").join(caller, "caller_id", "left_semi").select("service_id", "rpc", "caller_id").distinct()


def rpc_callers(links: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(method_id, service_id, rpc, caller_id): for each handler method, the calls over the wire that reach it."""
    owner = enclosing_type(symbols).select(F.col("id").alias("method_id"), "type_id")
    served = links.where(F.col("role") == S.SERVES).select("service_id", F.col("symbol_id").alias("type_id")).distinct()
    names = symbols.select(F.col("id").alias("method_id"), X.same_rpc(F.col("name")).alias("key"))
    mine = owner.join(served, "type_id").join(names, "method_id").select("method_id", "service_id", "key").distinct()
    calls = client_calls(links, symbols, files, edges).withColumn("key", X.same_rpc(F.col("rpc")))
    # A key follows from a name, so no pair of a distinct method and a distinct call comes twice.
    return paired(calls, mine, ["service_id", "key"]).where("caller_id <> method_id").select("method_id", "service_id", "rpc", "caller_id")


def rpc_callers_of_type(links: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(type_id, service_id, rpc, caller_id): for each type that serves, the calls over the wire that name one of its members."""
    names = symbols.select(F.col("id").alias("method_id"), X.same_rpc(F.col("name")).alias("key"))
    mine = handler_members(links, symbols).join(names, "method_id").select("type_id", "service_id", "key").distinct()
    calls = client_calls(links, symbols, files, edges).withColumn("key", X.same_rpc(F.col("rpc")))
    return paired(calls, mine, ["service_id", "key"]).select("type_id", "service_id", "rpc", "caller_id")


def outgoing_services(links: DataFrame, services: DataFrame, symbols: DataFrame, files: DataFrame, reached: DataFrame) -> DataFrame:
    """(symbol_id, called, deployed): services that a symbol calls, with the deployed ones (if any) that run a hand-written server of each."""
    named = services.select(F.col("id").alias("service_id"), F.concat_ws(".", "pkg", "name").alias("called"))
    mine = links.where(F.col("role") == S.CALLS_SERVICE).select("symbol_id", "service_id").distinct().join(named, "service_id")
    own = files.where("not generated").select(F.col("id").alias("def_file_id"))
    hand = symbols.join(own, "def_file_id", "left_semi").select(F.col("id").alias("server"))
    servers = links.where(F.col("role") == S.SERVES).select("service_id", F.col("symbol_id").alias("server")).distinct().join(hand, "server", "left_semi")
    run = servers.join(reached.select(F.col("symbol_id").alias("server"), F.col("service").alias("deployed")), "server").select("service_id", "deployed").distinct()
    return mine.join(run, "service_id", "left").select("symbol_id", "called", "deployed").distinct()


def rpc_targets(links: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller_id, service_id, rpc, method_id): handler methods that a symbol's own calls reach, in other files."""
    file_of = symbols.select("id", F.col("def_file_id").alias("file"))
    names = symbols.select(F.col("id").alias("method_id"), X.same_rpc(F.col("name")).alias("key"))
    own = files.where("not generated").select(F.col("id").alias("def_file_id"))
    hand = symbols.join(own, "def_file_id", "left_semi").select(F.col("id").alias("method_id"))
    served = handler_members(links, symbols).join(names, "method_id").join(hand, "method_id", "left_semi").select("service_id", "method_id", "key").distinct()
    calls = client_calls(links, symbols, files, edges).withColumn("key", X.same_rpc(F.col("rpc")))
    met = calls.join(served, ["service_id", "key"]).where("caller_id <> method_id")
    met = met.join(file_of.select(F.col("id").alias("caller_id"), F.col("file").alias("f1")), "caller_id").join(file_of.select(F.col("id").alias("method_id"), F.col("file").alias("f2")), "method_id")
    return met.where("f1 <> f2").select("caller_id", "service_id", "rpc", "method_id").distinct()


def rpc_targets_by_binding(links: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, service_id, method_id, checked): handler methods of the services that a symbol is bound to, in other languages.

    A method is kept if the service's client has an RPC of its name; where no client names its
    RPCs every member is kept and marked as not checked.
    """
    named = symbols.select(F.col("id").alias("member_id"), X.same_rpc(F.col("name")).alias("key"))
    clients = links.where((F.col("role") == S.CALLS_SERVICE) & F.col("via_symbol").isNotNull()).select("service_id", F.col("via_symbol").alias("type_id")).distinct()
    rpcs = clients.join(members(symbols).select("type_id", "member_id"), "type_id", "left").join(named, "member_id", "left").select("service_id", "key").distinct()
    # A client without members, or no client at all, leaves the service's RPCs unnamed.
    bare = links.select("service_id").distinct().join(rpcs, "service_id", "left").groupBy("service_id").agg(F.count(F.when(F.col("key").isNull(), 1)).alias("bare"))
    own = files.where("not generated").select(F.col("id").alias("def_file_id"))
    method = symbols.join(own, "def_file_id", "left_semi").select(F.col("id").alias("method_id"), X.same_rpc(F.col("name")).alias("key"), F.col("lang").alias("there"))
    served = handler_members(links, symbols).select("service_id", "method_id").distinct().join(method, "method_id")
    vouched = rpcs.where("key is not null").withColumn("vouched", F.lit(True))
    served = served.join(vouched, ["service_id", "key"], "left").join(bare, "service_id").where("vouched or bare > 0")
    mine = links.where(F.col("role") == S.CALLS_SERVICE).select("symbol_id", "service_id").distinct().join(symbols.select(F.col("id").alias("symbol_id"), F.col("lang").alias("here")), "symbol_id")
    served = served.select("service_id", "method_id", "there", F.coalesce("vouched", F.lit(False)).alias("checked"))
    out = paired(mine, served, ["service_id"]).where("symbol_id <> method_id and here <> there")
    return out.select("symbol_id", "service_id", "method_id", "checked")


def services_called(links: DataFrame, services: DataFrame) -> DataFrame:
    """(symbol_id, service): names of the services that a symbol calls."""
    named = services.select(F.col("id").alias("service_id"), F.concat_ws(".", "pkg", "name").alias("service"))
    return links.where(F.col("role") == S.CALLS_SERVICE).join(named, "service_id").select("symbol_id", "service").distinct()


def service_pivot(links: DataFrame, services: DataFrame) -> DataFrame:
    """(service_id, serves, calls) for every service, linked or not."""
    n = links.groupBy(F.col("service_id").alias("id")).agg(F.count(F.when(F.col("role") == 0, 1)).alias("serves"), F.count(F.when(F.col("role") == 1, 1)).alias("calls"))
    return services.join(n, "id", "left").select(F.col("id").alias("service_id"), F.coalesce("serves", F.lit(0)).alias("serves"), F.coalesce("calls", F.lit(0)).alias("calls"))


def affects_hops(roots: DataFrame, links: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, depth: int = 12, hops: int = 4, start: DataFrame | None = None) -> DataFrame:
    """(root, hop, method_id, service_id, rpc, caller_id): calls over the wire that a change of each root can reach.

    Each hop walks production callers inward, meets handler methods, and goes on from the calls
    that reach them; a caller is followed once for each root.  *start* (root, node) may add nodes
    to walk from, such as a handler's own methods, which are not among its callers.
    """
    test = symbols.join(files.where("is_test").select(F.col("id").alias("def_file_id")), "def_file_id", "left_semi").select(F.col("id").alias("src"))
    inward = edges.where(F.col("kind") == S.CALLS).select("src", "dst").distinct().join(test, "src", "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    inward = staged(inward, "inward")
    wire = staged(rpc_callers(links, symbols, files, edges), "wire")
    front = roots.select("root", F.col("root").alias("node"))
    front = front if start is None else front.unionByName(start.select("root", "node")).distinct()
    seen, out = None, None
    for hop in range(1, hops + 1):
        near = distances(front, inward, depth).select("root", F.col("node").alias("method_id"))
        met = near.join(wire, "method_id").select("root", F.lit(hop).alias("hop"), "method_id", "service_id", "rpc", "caller_id")
        if seen is not None:
            met = met.join(seen, ["root", "caller_id"], "left_anti")
        met = staged(met.select("root", "hop", "method_id", "service_id", "rpc", "caller_id"), "hop")
        if met.isEmpty():
            out = met if out is None else out
            break
        out = met if out is None else out.unionAll(met)
        new = met.select("root", "caller_id").distinct()
        seen = new if seen is None else seen.unionAll(new)
        front = new.select("root", F.col("caller_id").alias("node"))
    return out


def hop_groups(hops: DataFrame, runs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(root, hop, from, to, service_id, path, sites, rpcs): hops by the services that make and take the call and by the file of the call.

    *runs* (id, service) attributes symbols to deployed services; a side that none runs is null.
    """
    site = symbols.select(F.col("id").alias("caller_id"), F.col("def_file_id").alias("file_id")).join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("caller_id", "path")
    makes = runs.select(F.col("id").alias("caller_id"), F.col("service").alias("from")).distinct()
    takes = runs.select(F.col("id").alias("method_id"), F.col("service").alias("to")).distinct()
    rows = hops.join(site, "caller_id", "left").join(makes, "caller_id", "left").join(takes, "method_id", "left")
    grouped = rows.groupBy("root", "hop", "from", "to", "service_id", "path")
    return grouped.agg(F.count_distinct("caller_id").alias("sites"), F.array_join(F.array_sort(F.collect_set("rpc")), ",").alias("rpcs"))


def rpc_chain(roots: DataFrame, links: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, depth: int = 4, local: int = 2) -> DataFrame:
    """(root, hop, caller_id, service_id, method_id): calls over the wire outward from each root, through *local* levels of its own callees."""
    outward = staged(edges.where(F.col("kind") == S.CALLS).select("src", "dst").distinct(), "outward")
    wire = staged(rpc_targets(links, symbols, files, edges), "targets")
    front, seen, out = roots.select("root", F.col("root").alias("node")), None, None
    for hop in range(1, depth + 1):
        near = distances(front, outward, local).select("root", F.col("node").alias("caller_id")).distinct()
        met = near.join(wire, "caller_id").select("root", F.lit(hop).alias("hop"), "caller_id", "service_id", "method_id")
        if seen is not None:
            met = met.join(seen, ["root", "method_id"], "left_anti")
        met = staged(met.select("root", "hop", "caller_id", "service_id", "method_id"), "chain")
        if met.isEmpty():
            out = met if out is None else out
            break
        out = met if out is None else out.unionAll(met)
        new = met.select("root", "method_id").distinct()
        seen = new if seen is None else seen.unionAll(new)
        front = new.select("root", F.col("method_id").alias("node"))
    return out


def rpc_mentions(lines: DataFrame, links: DataFrame, symbols: DataFrame, most: int = 6) -> DataFrame:
    """(path, line, rpc): lines that call a known RPC by name, ``.rpc(``; the first name of a line, *most* lines of a path.

    Names are looked up by equality on the identifiers of a line, not by searching it for each.
    """
    from factloom.operators.edges import ranked

    via = links.where((F.col("role") == S.CALLS_SERVICE) & F.col("via_symbol").isNotNull()).select(F.col("via_symbol").alias("type_id")).distinct()
    names = via.join(members(symbols).select("type_id", F.col("member_id").alias("id")), "type_id").join(symbols.select("id", "name"), "id").select(F.col("name").alias("rpc")).distinct()
    called = F.posexplode(F.regexp_extract_all("text", F.lit(r"\.([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))
    met = lines.select("path", "line", called.alias("at", "rpc")).join(names, "rpc")
    first = met.groupBy("path", "line").agg(F.min(F.struct("at", "rpc")).alias("f")).select("path", "line", F.col("f.rpc").alias("rpc"))
    return ranked(first, ["path"], [F.asc("line")]).where(F.col("rank") <= most).select("path", "line", "rpc")
